"""Forum listings landed as JSON: posts and their comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import format_epoch, safe_text
from renown.operators.caps import capped_threads

POST_SCHEMA = ("struct<data:struct<children:array<struct<data:struct<title:string, selftext:string, "
               "permalink:string, created_utc:double, score:int, num_comments:int>>>>>")
COMMENTS_SCHEMA = ("array<struct<data:struct<children:array<struct<data:struct<body:string, permalink:string, "
                   "created_utc:double, score:int>>>>>>")
HOST = "https://reddit.com"


def extract_posts(landing: DataFrame, as_of: str | None = None, max_age_days: int = lx.MAX_POST_AGE_DAYS) -> DataFrame:
    """Search listings -> one row per post.  Text is the title, plus a blank
    line and the body when the body is non-empty.  With ``as_of`` posts older
    than the cutoff are dropped."""
    p = landing.select("*", F.from_json("payload", POST_SCHEMA).alias("_j"))
    p = p.select("*", F.posexplode(F.coalesce("_j.data.children", F.array())).alias("post_pos", "_c"))
    d = F.col("_c.data")
    title = F.coalesce(d["title"], F.lit(""))
    body = F.coalesce(d["selftext"], F.lit(""))
    text = F.when(body != "", F.concat(title, F.lit("\n\n"), body)).otherwise(title)
    out = p.select(
        *[c for c in landing.columns if c not in ("payload",)], "post_pos",
        F.lit("reddit").alias("source_platform"),
        F.concat(F.lit(HOST), F.coalesce(d["permalink"], F.lit(""))).alias("source_url"),
        safe_text(text).alias("raw_text"),
        format_epoch(F.coalesce(d["created_utc"], F.lit(0.0))).alias("date_raw"),
        F.timestamp_micros((F.coalesce(d["created_utc"], F.lit(0.0)) * 1e6).cast("long")).alias("event_ts"),
        d["title"].alias("title"), d["permalink"].alias("permalink"),
        F.coalesce(d["score"], F.lit(0)).alias("score"), F.coalesce(d["num_comments"], F.lit(0)).alias("num_comments"),
        F.lit("general").alias("reviewer_type"), F.lit("post").alias("type"),
    )
    if as_of is not None:
        cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(max_age_days))
        out = out.where(F.col("event_ts") >= cutoff)
    return out


def extract_comments(landing: DataFrame, per_post: int = lx.FORUM_COMMENTS_PER_POST) -> DataFrame:
    """Comment listings -> one row per kept comment: the second listing's
    first ``per_post`` children (cut before filtering), minus empty,
    '[deleted]' and '[removed]' bodies."""
    c = landing.select("*", F.from_json("payload", COMMENTS_SCHEMA).alias("_j"))
    kids = F.slice(F.coalesce(F.get(F.col("_j"), 1)["data"]["children"], F.array()), 1, per_post)
    c = c.select("*", F.posexplode(kids).alias("comment_pos", "_c"))
    d = F.col("_c.data")
    body = F.coalesce(d["body"], F.lit(""))
    c = c.where(~body.isin("", "[deleted]", "[removed]"))
    link = F.coalesce(d["permalink"], F.lit(""))
    return c.select(
        *[x for x in landing.columns if x not in ("payload",)], "comment_pos",
        F.lit("reddit").alias("source_platform"),
        F.when(link != "", F.concat(F.lit(HOST), link)).otherwise(F.lit("")).alias("source_url"),
        safe_text(body).alias("raw_text"),
        format_epoch(F.coalesce(d["created_utc"], F.lit(0.0))).alias("date_raw"),
        F.coalesce(d["score"], F.lit(0)).alias("score"),
        F.lit("general").alias("reviewer_type"), F.lit("comment").alias("type"),
    )


def taken_threads(posts: DataFrame, comments: DataFrame, cap: int = lx.FORUM_SOFT_CAP,
                  keys=("company", "conv_id")) -> tuple[DataFrame, DataFrame]:
    """The posts a crawl takes under its soft cap (a post counts 1 plus its
    kept comments) and the comments of exactly those posts, each with its
    post's title as ``parent_post``.  ``posts`` have passed the age cutoff;
    ``keys`` name one thread, the last one in crawl order.  A post without
    a permalink has no comments to read."""
    linked = F.coalesce("permalink", F.lit("")) != ""
    n = comments.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    p = posts.join(n, list(keys), "left").withColumn("n_comments", F.when(linked, F.coalesce("_n", F.lit(0))).otherwise(0)).drop("_n")
    taken = capped_threads(p.withColumn("seq", F.struct(keys[-1], "post_pos")), cap).drop("seq", "rows_before")
    parents = taken.where(linked).select(*keys, F.coalesce("title", F.lit("")).alias("parent_post"))
    return taken, comments.join(parents, list(keys))
