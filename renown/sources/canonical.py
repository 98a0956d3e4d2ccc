"""One canonical mention row for every platform's extract, and their union.

A mention is (company, seq, source_platform, source_url, raw_text, date_raw,
rating, reviewer_type, metadata).  ``metadata`` is one struct that holds the
fields of all platforms, null where a platform has none, so a field added for
one platform changes no other extractor.  ``seq`` is the order key (platform,
payload position, item within the payload).  The crawled platforms' reviewer
types and row types are fixed per source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renown.functions import lexicons as lx
from renown.operators.caps import cascade_first_nonempty
from renown.sources import pages as PG

METADATA_FIELDS = [
    ("subreddit", "string"), ("score", "double"), ("num_comments", "int"), ("type", "string"),
    ("parent_post", "string"), ("star_rating", "double"), ("review_count", "int"),
    ("review_index", "int"), ("pros", "string"), ("cons", "string"), ("reviewer_role", "string"),
    ("source_site", "string"), ("salary_info", "string"), ("followers", "string"),
    ("employees", "string"), ("likes", "string"), ("headline", "string"), ("title", "string"),
    ("search_engine", "string"), ("position", "int"),
]
_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}
METADATA_TYPE = T.StructType([T.StructField(n, _TYPES[t]) for n, t in METADATA_FIELDS])

REVIEWER_TYPE = {"reddit": "general", "google_maps": "customer", "glassdoor": "employee", "topjobs": "job_seeker",
                 "linkedin": "general", "facebook": "customer", "news": "press", "web": "general"}


def canonical(df: DataFrame, platform: str, position: Column, item: Column, kind: str, /, url=None, date=None, rating=None, **metadata) -> DataFrame:
    """The extract ``df`` (company, raw_text and its own columns) as canonical
    rows.  ``metadata`` names the fields it has and the columns they come from;
    ``url``, ``date`` and ``rating`` name theirs."""
    unknown = metadata.keys() - dict(METADATA_FIELDS).keys()
    if unknown:
        raise ValueError(f"no metadata field {sorted(unknown)}")
    given = {"type": F.lit(kind)} | {k: F.col(c) for k, c in metadata.items()}
    meta = F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in METADATA_FIELDS])
    value = lambda c, t: (F.lit(None) if c is None else F.col(c)).cast(t)
    seq = F.struct(F.lit(lx.PLATFORMS.index(platform)).alias("platform_ord"), position.cast("long").alias("position"), item.cast("int").alias("item"))
    return df.select("company", seq.alias("seq"), F.lit(platform).alias("source_platform"), F.coalesce(value(url, "string"), F.lit("")).alias("source_url"),
                     "raw_text", value(date, "string").alias("date_raw"), value(rating, "double").alias("rating"),
                     F.lit(REVIEWER_TYPE[platform]).alias("reviewer_type"), meta.alias("metadata"))


def forum_mentions(posts: DataFrame, comments: DataFrame) -> list[DataFrame]:
    """Taken posts and their comments (see ``forum.taken_threads``)."""
    return [canonical(posts, "reddit", F.col("conv_id"), F.lit(0), "post", "source_url", "date_raw",
                      subreddit="subreddit", score="score", num_comments="num_comments"),
            canonical(comments, "reddit", F.col("conv_id"), F.col("comment_pos") + 1, "comment", "source_url", "date_raw",
                      subreddit="subreddit", score="score", parent_post="parent_post")]


def page_mentions(pages: DataFrame, elements: DataFrame, cards: DataFrame) -> list[DataFrame]:
    """The six page platforms.  ``pages``: (page_id, company, url, html);
    ``elements``: their element table with company; ``cards``: the element
    table of the card site's pages, with company."""
    page = F.col("page_id")
    owner = pages.select("page_id", "company", F.col("url").alias("page_url"))
    owned = lambda df: df.drop("company").join(owner, "page_id")
    links = PG.profile_links(elements)
    articles = PG.news_articles(elements)
    news = PG.news_cascade(articles, PG.news_links(elements, already=articles))
    reviews = PG.employee_review_cascade(PG.employee_reviews(elements, pages), PG.secondary_employee_reviews(elements))
    card_owner = cards.select("page_id", "company").distinct()
    return [
        canonical(PG.map_listing(pages), "google_maps", page, F.lit(0), "business_listing", "source_url", None, "rating",
                  star_rating="rating", review_count="review_count"),
        canonical(owned(PG.map_reviews(elements)), "google_maps", page, F.col("review_index") + 1, "review", "page_url", None, "rating",
                  review_index="review_index"),
        canonical(owned(reviews), "glassdoor", page, F.col("cascade_rank"), "employee_review", "page_url", None, "rating",
                  pros="pros", cons="cons", source_site="source_site"),
        canonical(owned(PG.job_listings(elements)), "topjobs", page, F.col("item_rank"), "job_listing", "source_url", salary_info="salary_info"),
        canonical(PG.job_cards_b(cards).join(card_owner, "page_id"), "topjobs", page, F.col("card_rank") + 100, "job_listing", "source_url",
                  salary_info="salary_info"),
        canonical(owned(PG.job_cards_c(elements)), "topjobs", page, F.col("item_rank") + 200, "job_listing", "source_url"),
        canonical(owned(links), "linkedin", page, F.col("item_rank"), "company_profile", "source_url", followers="followers", employees="employees"),
        canonical(owned(PG.profile_cards(elements, links)), "linkedin", page, F.col("item_rank") + 100, "search_result"),
        canonical(owned(PG.social_pages(elements)), "facebook", page, F.col("item_rank"), "page_info", "source_url", None, "rating", likes="likes"),
        canonical(news, "news", F.col("cascade_rank"), F.lit(0), "news_article", "source_url", "date_raw", headline="headline", source_site="source_site"),
    ]


def web_mentions(results: DataFrame, blocks: DataFrame) -> DataFrame:
    """Web search: the first layout that gave a company anything, else the
    second, else the HTML results, cut to the web cap.  ``blocks``: HTML
    result blocks with company."""
    common = ["company", "tier", "at", "source_url", "raw_text", "title", "search_engine", "score", "position"]
    api = results.select("company", F.when(F.col("search_engine") == "engine_a", 0).otherwise(1).alias("tier"),
                         (F.col("grp") * 10 + F.col("result_pos")).alias("at"), "source_url", "raw_text", "title", "search_engine", "score", "position")
    html = blocks.select("company", F.lit(2).alias("tier"), F.col("page_id").alias("at"), "source_url", "raw_text", "title", "search_engine",
                         F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("position"))
    first = cascade_first_nonempty(api.select(*common).unionByName(html.select(*common)), "tier")
    w = Window.partitionBy("company").orderBy("at")
    first = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= lx.PLATFORM_CAPS["web"])
    return canonical(first, "web", F.col("at"), F.lit(0), "web_result", "source_url", title="title", search_engine="search_engine",
                     score="score", position="position")


def canonical_union(parts: list[DataFrame]) -> DataFrame:
    """All platforms' rows (concatenation in platform order is their ``seq``)."""
    return reduce(DataFrame.unionByName, parts)
