"""Adapter views: reshape the given tables into the reputation data model.

Every view is derived by Spark from the driver tables, so its size grows with
them.  The same rules are written as DuckDB SQL in ``renown.plans.oracle`` for
the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.sources.canonical import METADATA_TYPE  # noqa: F401

N_COMPANIES = 23
# tokens that occur in the synthetic prose; company i gets ALIAS_TOKENS[i % 12]
ALIAS_TOKENS = ["erthat", "enbl", "theou", "onerth", "éle", "ung", "ción", "is an",
                "blest", "theaen", "wherin", "ndou"]
EXTRA_ALIASES = [("99x", "99x Technology"), ("MIT", "Millennium IT"), ("SLT", "Sri Lanka Telecom")]
AS_OF = "2024-01-31 00:00:00"
FORUM_EPOCH0 = 1704067200
SNAPSHOT_SOURCES = ["view", "click", "error", "purchase", "signup"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, idx_col) -> F.Column:
    """values[idx] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx_col + 1).cast("int"))


def company_name(idx_col) -> F.Column:
    return F.concat(F.lit("Company "), F.lpad(idx_col.cast("string"), 2, "0"))


def mentions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified mentions: documents left-joined with labels (one row per doc)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    x = d.join(lab, "doc_id", "left")
    i = F.col("doc_id")
    rating = F.when(i % 9 == 0, F.lit(None).cast("double")).otherwise((i % 5 + 1).cast("double"))
    s = lambda c: c.cast("string")
    meta = F.struct(
        F.concat(F.lit("sub"), s(i % 3)).alias("subreddit"),
        (i % 50).cast("double").alias("score"),
        (i % 7).cast("int").alias("num_comments"),
        F.when(i % 2 == 0, F.lit("post")).otherwise(F.lit("comment")).alias("type"),
        F.lit(None).cast("string").alias("parent_post"),
        rating.alias("star_rating"),
        (i % 97).cast("int").alias("review_count"),
        (i % 20).cast("int").alias("review_index"),
        F.when(i % 6 != 0, F.concat(F.lit("pro "), s(i % 11))).alias("pros"),
        F.when(i % 6 != 0, F.concat(F.lit("con "), s(i % 13))).alias("cons"),
        F.concat(F.lit("role "), s(i % 6)).alias("reviewer_role"),
        F.concat(F.lit("site"), s(i % 9)).alias("source_site"),
        F.when(i % 4 == 0, F.concat(F.lit("LKR "), s(i * 10))).alias("salary_info"),
        F.when(i % 6 == 1, s(i * 3)).alias("followers"),
        F.when(i % 6 == 2, s(i % 500)).alias("employees"),
        F.when(i % 6 == 3, s(i * 7)).alias("likes"),
        F.when(i % 10 != 0, F.substring("text", 1, 40)).alias("headline"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("search_engine"),
        F.lit(None).cast("int").alias("position"),
    )
    return x.select(
        company_name(i % N_COMPANIES).alias("company"),
        i.alias("seq"),
        _pick(lx.PLATFORMS, i % 8).alias("source_platform"),
        F.concat(F.lit("https://site"), s(i % 50), F.when(i % 3 == 0, F.lit(".lk")).otherwise(F.lit(".com")),
                 F.lit("/p/"), s(i % 200)).alias("source_url"),
        F.col("text").alias("raw_text"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 730).cast("int")), "yyyy-MM-dd").alias("date_raw"),
        rating.alias("rating"),
        F.when(F.col("toxic") == 1, F.lit("negative")).when(F.col("quality") == 1, F.lit("positive"))
        .otherwise(F.lit("neutral")).alias("sentiment"),
        ((i % 101).cast("double") / 100.0).alias("confidence"),
        _pick(lx.REVIEWER_TYPES, i % 5).alias("reviewer_type"),
        F.array(_pick(lx.THEMES, i % 12), _pick(lx.THEMES, (i * 7 + 3) % 12)).alias("themes"),
        _pick(lx.SEVERITIES, i % 4).alias("severity"),
        F.col("lang").alias("language_detected"),
        meta.alias("metadata"),
    )


def aliases_fx(spark: SparkSession) -> DataFrame:
    rows = [(i, ALIAS_TOKENS[i % 12], f"Company {i:02d}") for i in range(N_COMPANIES)]
    rows += [(N_COMPANIES + k, a, f) for k, (a, f) in enumerate(EXTRA_ALIASES)]
    return spark.createDataFrame(rows, "ord int, alias string, full_name string")


def default_aliases(spark: SparkSession) -> DataFrame:
    """The shipped alias dimension (fixed values)."""
    rows = [(k, a, f) for k, (a, f) in enumerate(lx.COMPANY_ALIASES)]
    return spark.createDataFrame(rows, "ord int, alias string, full_name string")


def _conf_text(i) -> F.Column:
    r = i % 101
    return F.when(r == 100, F.lit("1.0")).otherwise(F.concat(F.lit("0."), F.lpad(r.cast("string"), 2, "0")))


def responses_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated classifier output per mention (join target of the response join)."""
    m = mentions_fx(spark, sf_dir)
    i = F.col("seq")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    themes = F.concat(F.lit("["), q(F.col("themes")[0]), F.lit(", "), q(F.col("themes")[1]), F.lit("]"))
    head = F.concat(F.lit('{"sentiment": '), q(F.col("sentiment")))
    conf_num = F.concat(F.lit(', "confidence": '), _conf_text(i))
    conf_str = F.concat(F.lit(', "confidence": '), q(_conf_text(i)))
    rest_rt = F.concat(F.lit(', "reviewer_type": '), q(F.col("reviewer_type")))
    rest_th = F.concat(F.lit(', "themes": '), themes, F.lit(', "severity": '), q(F.col("severity")))
    lang = F.concat(F.lit(', "language_detected": '), q(F.col("language_detected")), F.lit("}"))
    full = F.concat(head, conf_num, rest_rt, rest_th, lang)
    k = i % 10
    resp = (
        F.when(k == 0, F.lit("not json"))
        .when(k == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(k == 2, F.lit("[1]"))
        .when(k == 3, F.concat(head, conf_num, rest_rt, lang))
        .when(k == 4, F.concat(head, conf_str, rest_rt, rest_th, lang))
        .otherwise(full)
    )
    return m.where(i % 50 != 7).select(i.alias("seq"), resp.alias("response"))


def landing_forum_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum payloads landed as JSON: one search listing per post, one
    comments listing (post listing + comment listing) per post."""
    c = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id")
    permalink = F.concat(F.lit("/r/sub"), (cid % 3).cast("string"), F.lit("/comments/c"), cid.cast("string"))
    posts = c.where(F.col("turn") == 0).select(
        company_name(cid % N_COMPANIES).alias("company"), cid.alias("conv_id"),
        F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(
            F.substring("text", 1, 40).alias("title"),
            F.col("text").alias("selftext"),
            permalink.alias("permalink"),
            (F.lit(FORUM_EPOCH0) + cid * 86400).cast("double").alias("created_utc"),
            (cid % 17).cast("int").alias("score"),
            (cid % 5).cast("int").alias("num_comments"),
        ).alias("data"))).alias("children")).alias("data"))).alias("payload"),
        F.concat(F.lit("sub"), (cid % 3).cast("string")).alias("subreddit"),
    )
    body = F.when((cid + F.col("turn")) % 9 == 0, F.lit("[deleted]")).otherwise(F.col("text"))
    comments = (
        c.where(F.col("turn") >= 1)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct(
            F.col("turn"),
            F.struct(
                body.alias("body"),
                F.concat(permalink, F.lit("/t"), F.col("turn").cast("string")).alias("permalink"),
                (F.lit(FORUM_EPOCH0) + cid * 86400 + F.col("turn") * 60).cast("double").alias("created_utc"),
                (F.col("turn") * 3).cast("int").alias("score"),
            ).alias("data"),
        ))).alias("cs"))
        .select(
            "conv_id",
            # [post listing, comment listing]; the first listing is not read
            F.concat(F.lit('[{"data": {"children": []}}, '),
                     F.to_json(F.struct(F.struct(F.transform("cs", lambda e: F.struct(e["data"].alias("data"))).alias("children")).alias("data"))),
                     F.lit("]")).alias("payload"),
        )
    )
    search = posts.select(
        "company", F.lit("reddit").alias("platform"), F.lit("search").alias("endpoint"),
        F.concat(F.lit("https://old.reddit.com/r/"), F.col("subreddit"), F.lit("/search.json")).alias("url"),
        F.col("conv_id").cast("int").alias("position"), "subreddit", "payload", "conv_id",
    )
    comm = posts.select("company", "conv_id", "subreddit").join(comments, "conv_id").select(
        "company", F.lit("reddit").alias("platform"), F.lit("comments").alias("endpoint"),
        F.lit("").alias("url"), F.col("conv_id").cast("int").alias("position"), "subreddit", "payload", "conv_id",
    )
    return search.unionByName(comm)


def snapshots_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("company"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("cached_at"),
        F.col("props").alias("payload"),
        F.col("event_id").alias("seq"),
    )


def usage_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("company"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.floor("value").cast("long").alias("tokens_used"),
        F.lit(1).cast("long").alias("calls_made"),
        F.col("ts").alias("run_at"),
    )


def _one_company(id_col) -> F.Column:
    """The single company 'all' as a data-dependent expression: a literal
    would let the optimizer fold every ``company = company`` lookup join into
    a condition-less join, a plan shape real company columns never have."""
    return F.when(F.col(id_col).isNotNull(), F.lit("all")).otherwise(F.lit("none"))


def vectors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(_one_company("vec_id").alias("company"), F.col("vec_id").alias("seq"), F.col("embedding"))


def documents_one_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(_one_company("doc_id").alias("company"), F.col("doc_id").alias("seq"), F.col("text").alias("raw_text"))


def landing_web_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed as web-search responses: groups of five documents
    (doc_id div 5) form one response, alternating the two result layouts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = F.floor(F.col("doc_id") / 5).cast("long")
    url = F.concat(F.lit("https://web"), F.col("doc_id").cast("string"), F.lit(".lk/r"))
    title = F.substring("text", 1, 30)
    a = F.struct(url.alias("url"), title.alias("title"), F.col("text").alias("content"),
                 ((F.col("doc_id") % 100).cast("double") / 100.0).alias("score"))
    b = F.struct(url.alias("link"), title.alias("title"), F.col("text").alias("snippet"),
                 (F.col("doc_id") % 5 + 1).cast("int").alias("position"))
    x = d.select(g.alias("grp"), "doc_id", a.alias("a"), b.alias("b"))
    # at most five rows per group: a bounded collect
    packed = x.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("doc_id", "a", "b"))).alias("rs"))
    payload = F.when(F.col("grp") % 2 == 0, F.to_json(F.struct(F.transform("rs", lambda r: r["a"]).alias("results")))) \
        .otherwise(F.to_json(F.struct(F.transform("rs", lambda r: r["b"]).alias("organic_results"))))
    return packed.select(company_name(F.col("grp") % N_COMPANIES).alias("company"), "grp", payload.alias("payload"))


def _fmt(x) -> F.Column:
    return F.format_number(x, 0)


def page_block(k, company) -> F.Column:
    """Synthetic listing/review/link markup derived from the page id, appended
    to each page so every page extractor has input (FIXTURES: pages wrapped
    with snippets and links generated from page_id)."""
    s = lambda c: c.cast("string")
    site = F.element_at(F.array(*[F.lit(x) for x in lx.NEWS_SITES]), (k % 9 + 1).cast("int"))
    site2 = F.element_at(F.array(*[F.lit(x) for x in lx.NEWS_SITES]), ((k + 4) % 9 + 1).cast("int"))
    return F.concat(
        F.lit('<section class="fx">'),
        F.when(k % 6 != 0, F.concat(F.lit('<div class="maps-card">Rated '), s(k % 5 + 1), F.lit("."), s(k % 10),
                                    F.lit(" stars · "), _fmt(k * 13), F.lit(" reviews</div>"))).otherwise(F.lit("")),
        F.lit('<div data-review-id="r'), s(k), F.lit('-1" aria-label="'), s(k % 5 + 1), F.lit(' stars">First review of page '),
        s(k), F.lit(" by a visitor</div>"),
        F.lit('<div data-review-id="r'), s(k), F.lit('-2" aria-label="Rated">Second review '), s(k), F.lit("</div>"),
        F.lit('<span class="rating-value">'), s(k % 5), F.lit(".5</span>"),
        F.lit('<div class="employee-review">Pros friendly team '), s(k), F.lit(" Cons slow promotions</div>"),
        F.lit('<div class="review-container">Indeed review '), s(k), F.lit(" without markers</div>"),
        F.lit('<ul><li class="job-post">Engineer at '), company, F.lit(" paying Rs. "), _fmt(k * 100), F.lit(" - "),
        _fmt(k * 150), F.lit("</li></ul>"),
        F.lit('<div class="vacancy-row">Vacancy '), s(k), F.lit(" open now</div>"),
        F.lit('<p><a href="https://www.linkedin.com/company/co-'), s(k % 40), F.lit('/about">'), company, F.lit(" | "),
        _fmt(k * 3), F.lit(" followers | "), s(k % 50), F.lit("-"), s(k % 50 + 10), F.lit(" employees</a></p>"),
        F.lit('<div class="entity-result">Entity result card for page '), s(k), F.lit("</div>"),
        F.lit('<p><a href="https://m.facebook.com/page'), s(k % 30), F.lit('?ref=s">Page '), s(k % 30), F.lit(" has "),
        s(k % 9), F.lit(".5K likes and "), s(k % 5), F.lit(".5 out of 5</a></p>"),
        F.lit('<div class="news-item"><h3>Headline '), s(k), F.lit(" about "), company, F.lit('</h3><a href="https://www.'),
        site, F.lit("/news/"), s(k), F.lit('">more</a><span class="snippet">Snippet text '), s(k),
        F.lit('</span><span class="date">'), s(k % 24), F.lit(" hours ago</span></div>"),
        F.lit('<a href="https://www.'), site2, F.lit("/story/"), s(k), F.lit('">Story number '), s(k), F.lit(" in the paper</a>"),
        F.when(k % 3 == 0, F.concat(F.lit('<a href="https://boards.greenhouse.io/co'), s(k), F.lit('">Apply here</a>'))).otherwise(F.lit("")),
        F.lit('<a href="https://jobs.example.com/'), s(k), F.lit('">View jobs</a>'),
        F.lit('<a href="https://jobs.example.com/'), s(k), F.lit('/all">Search jobs</a>'),
        F.lit('<div class="g"><a href="https://shop'), s(k % 7), F.when(k % 2 == 1, F.lit(".lk")).otherwise(F.lit(".com")),
        F.lit("/r/"), s(k), F.lit('"><h3>Result title '), s(k), F.lit('</h3></a><span class="st">Snippet for result '), s(k),
        F.when(k % 4 == 0, F.lit(" colombo")).otherwise(F.lit("")), F.lit("</span></div>"),
        F.lit("</section>"),
    )


def wrapped_pages_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    company = company_name(k % N_COMPANIES)
    return p.select("page_id", "url", company.alias("company"),
                    F.concat(F.col("html"), page_block(k, company)).alias("html"))
