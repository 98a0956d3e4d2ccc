"""Per-company, per-source aggregates that make up the report sections.

Every aggregate is a ``groupBy`` with partial (map-side) aggregation or a
row_number filter with a literal limit (partial top-k before the shuffle).
Lists whose order matters carry ``seq`` and are sorted after collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renown.functions import lexicons as lx

KEYS = ["company", "source_platform"]
def EMPTY_():
    return F.array().cast("array<string>")


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing-value defaults: platform web, sentiment neutral, themes [],
    confidence 0."""
    return (df.withColumn("source_platform", F.coalesce("source_platform", F.lit("web")))
            .withColumn("sentiment", F.coalesce("sentiment", F.lit("neutral")))
            .withColumn("themes", F.coalesce("themes", EMPTY_()))
            .withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))


def sentiment_counts() -> list[Column]:
    return [F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")]


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("result_count")).where("result_count > 0")


def sentiment_breakdown(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("result_count"), *sentiment_counts())


def sentiment_share(df: DataFrame, keys=KEYS) -> DataFrame:
    """Percent of each sentiment among the three (null when they sum to 0)."""
    b = sentiment_breakdown(df, keys)
    tot = F.col("positive") + F.col("negative") + F.col("neutral")
    return b.select(*keys, *[F.try_divide(F.col(s) * 100.0, tot).alias(f"{s}_pct") for s in ("positive", "negative", "neutral")])


def sentiment_by_reviewer(df: DataFrame) -> DataFrame:
    """Pivot: reviewer type x sentiment counts (values fixed, so one pass)."""
    return (df.groupBy("company", F.coalesce("reviewer_type", F.lit("general")).alias("reviewer_type"))
            .pivot("sentiment", lx.SENTIMENTS).count().na.fill(0, lx.SENTIMENTS))


def top_themes(df: DataFrame, k: int = 5, keys=KEYS) -> DataFrame:
    """Most frequent themes, ties broken by first appearance (seq, position)."""
    e = df.select(*keys, "seq", F.posexplode(F.coalesce("themes", EMPTY_())).alias("pos", "theme"))
    c = e.groupBy(*keys, "theme").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("first"))
    return c.withColumn("theme_rank", F.row_number().over(w)).where(F.col("theme_rank") <= k).select(*keys, "theme_rank", "theme", "n")


def quote_text(text) -> Column:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 200), F.lit("..."))).otherwise(t)


def sample_quotes(df: DataFrame, k: int = 3, keys=KEYS) -> DataFrame:
    """Top-k texts longer than 20 chars by confidence (desc), stable on seq."""
    q = df.where(F.length(F.coalesce("raw_text", F.lit(""))) > 20)
    w = Window.partitionBy(*keys).orderBy(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).desc(), "seq")
    return q.withColumn("quote_rank", F.row_number().over(w)).where(F.col("quote_rank") <= k).select(
        *keys, "quote_rank", quote_text("raw_text").alias("quote"))


def source_urls(df: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct non-empty urls with their first-seen seq (rows, not a list)."""
    u = df.where(F.coalesce("source_url", F.lit("")) != "")
    return u.groupBy(*keys, "source_url").agg(F.min("seq").alias("first_seq"))


def avg_rating_expr(rating="rating") -> Column:
    """Mean of non-null ratings rounded half-even to 1 decimal; 0 or none -> null."""
    a = F.avg(F.col(rating).cast("double"))
    return F.when(a.isNull() | (a == 0), F.lit(None).cast("double")).otherwise(F.call_function("format_number", a, F.lit("0.0")).cast("double"))


def avg_rating(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(avg_rating_expr().alias("avg_rating"))


def collect_ordered(value: Column, order: Column | None = None, where: Column | None = None) -> Column:
    """Values ordered by ``order`` (default seq; a sorted collect of (order, value))."""
    order = F.col("seq") if order is None else order
    cond = value.isNotNull() & (value.cast("string") != "")
    if where is not None:
        cond = cond & where
    s = F.array_sort(F.collect_list(F.when(cond, F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(s, lambda e: e["v"])


def first_value(value: Column) -> Column:
    ok = value.isNotNull() & (value.cast("string") != "")
    return F.min_by(F.when(ok, value), F.when(ok, F.col("seq")))


def last_value(value: Column) -> Column:
    ok = value.isNotNull() & (value.cast("string") != "")
    return F.max_by(F.when(ok, value), F.when(ok, F.col("seq")))


def hiring_trend(n) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return (F.when(n >= 10, F.lit("growing")).when(n >= 3, F.lit("stable"))
            .when(n >= 1, F.lit("shrinking")).otherwise(F.lit("none")))


def _url_lists(df: DataFrame, keys) -> DataFrame:
    u = source_urls(df, keys)
    return u.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "source_url"))),
                                            lambda e: e["source_url"]).alias("urls"))


def _theme_lists(df: DataFrame, keys) -> DataFrame:
    t = top_themes(df, 5, keys)
    return t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("theme_rank", "theme"))),
                                            lambda e: e["theme"]).alias("top_themes"))


def _quote_lists(df: DataFrame, keys) -> DataFrame:
    q = sample_quotes(df, 3, keys)
    return q.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("quote_rank", "quote"))),
                                            lambda e: e["quote"]).alias("sample_quotes"))


# columns of each platform's section, in report order
SECTION_COLUMNS = {
    "reddit": ["subreddits_searched", "result_count", "positive", "negative", "neutral", "top_themes", "sample_quotes", "urls"],
    "google_maps": ["result_count", "avg_rating", "review_count", "positive", "negative", "neutral", "top_themes",
                    "sample_quotes", "urls"],
    "glassdoor": ["result_count", "employee_count", "avg_rating", "top_pros", "top_cons", "roles_represented",
                  "positive", "negative", "neutral", "top_themes", "urls"],
    "topjobs": ["active_job_count", "salary_range_lkr", "all_salary_info", "hiring_trend", "result_count",
                "sample_quotes", "urls"],
    "linkedin": ["result_count", "followers", "employees", "positive", "negative", "neutral", "sample_quotes", "urls"],
    "facebook": ["result_count", "avg_rating", "page_likes", "positive", "negative", "neutral", "top_themes",
                 "sample_quotes", "urls"],
    "news": ["result_count", "articles", "latest_articles", "positive", "negative", "neutral", "top_themes", "urls"],
    "web": ["result_count", "positive", "negative", "neutral", "top_themes", "sample_quotes", "urls"],
}


def section_rows(df: DataFrame) -> DataFrame:
    """Every platform's section fields for every (company, platform) in one
    pass: one partial aggregate for the scalar fields plus one bounded
    top-k each for themes and quotes, and the distinct-url aggregate.
    Rows of platforms without a section keep only the common fields."""
    keys = KEYS
    d = with_defaults(df)
    meta = lambda f: F.col(f"metadata.{f}")
    sub = meta("subreddit")
    role = meta("reviewer_role")
    art = F.struct(
        F.coalesce(meta("headline"), F.substring(F.coalesce("raw_text", F.lit("")), 1, 100)).alias("headline"),
        F.coalesce(meta("source_site"), F.lit("unknown")).alias("source"),
        F.col("date_raw").alias("date"),
        F.col("sentiment").alias("sentiment"),
        F.coalesce("source_url", F.lit("")).alias("url"),
    )
    plat = F.col("source_platform")
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("result_count"),
        *sentiment_counts(),
        F.array_sort(F.collect_set(F.when((plat == "reddit") & (F.coalesce(sub, F.lit("")) != ""),
                                          F.concat(F.lit("r/"), sub)))).alias("subreddits_searched"),
        avg_rating_expr().alias("avg_rating"),
        F.coalesce(F.max(F.when(meta("review_count") != 0, meta("review_count"))), F.lit(0)).alias("review_count"),
        F.array_sort(F.collect_set(F.when((plat == "glassdoor") & (F.coalesce(role, F.lit("")) != ""), role))).alias("roles_represented"),
        first_value(F.when(plat == "topjobs", meta("salary_info"))).alias("salary_range_lkr"),
        collect_ordered(meta("salary_info"), where=plat == "topjobs").alias("all_salary_info"),
        last_value(F.when(plat == "linkedin", meta("followers"))).alias("followers"),
        last_value(F.when(plat == "linkedin", meta("employees"))).alias("employees"),
        last_value(F.when(plat == "facebook", meta("likes"))).alias("page_likes"),
        F.transform(F.array_sort(F.collect_list(F.when(plat == "news", F.struct(F.col("seq").alias("o"), art.alias("v"))))),
                    lambda e: e["v"]).alias("articles"),
    )
    base = (base.withColumn("latest_articles", F.slice("articles", 1, 5))
            .withColumn("employee_count", F.col("result_count"))
            .withColumn("active_job_count", F.col("result_count"))
            .withColumn("hiring_trend", hiring_trend("result_count")))
    out = base
    for p in (_theme_lists(d, keys), _quote_lists(d, keys), _url_lists(d, keys), _pros_cons_lists(d, keys)):
        out = out.join(p, keys, "left")
    for c in ("top_themes", "sample_quotes", "urls", "top_pros", "top_cons"):
        out = out.withColumn(c, F.coalesce(c, EMPTY_()))
    return out


def _pros_cons_lists(d: DataFrame, keys, k: int = 5) -> DataFrame:
    """First ``k`` non-empty pros and cons of employee reviews by seq.  Both
    lists come from one ranked pass with a literal bound, so Spark keeps a
    partial top-k per input partition instead of collecting every value."""
    e = d.where(F.col("source_platform") == "glassdoor").select(
        *keys, "seq", F.inline(F.array(F.struct(F.lit("pros").alias("kind"), F.col("metadata.pros").alias("v")),
                                       F.struct(F.lit("cons").alias("kind"), F.col("metadata.cons").alias("v")))))
    e = e.where(F.coalesce("v", F.lit("")) != "")
    w = Window.partitionBy(*keys, "kind").orderBy("seq")
    e = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_r", "v")))),
                                    lambda x: x["v"])
    return e.groupBy(*keys).agg(pick("pros").alias("top_pros"), pick("cons").alias("top_cons"))


def section_struct(rows: DataFrame, platform: str) -> F.Column:
    cols = SECTION_COLUMNS[platform]
    return F.struct(F.lit(lx.SECTION_NAMES[platform]).alias("platform"), *[F.col(c) for c in cols])


def section(df: DataFrame, platform: str) -> DataFrame:
    """The report section of one platform, one row per company."""
    rows = section_rows(df.where(F.col("source_platform") == platform))
    return rows.select("company", *SECTION_COLUMNS[platform], F.lit(lx.SECTION_NAMES[platform]).alias("platform"))


def sections_by_company(df: DataFrame) -> DataFrame:
    """One row per company with a nullable struct per section key (at most
    eight rows per company are folded, one per platform)."""
    rows = section_rows(df)
    aggs = [F.first(F.when(F.col("source_platform") == p, section_struct(rows, p)), ignorenulls=True).alias(lx.SECTION_KEYS[p])
            for p in lx.PLATFORMS]
    return rows.groupBy("company").agg(*aggs)
