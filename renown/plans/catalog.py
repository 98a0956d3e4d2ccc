"""Registered queries: each binds operators to the adapter views.

``QUERIES[name](spark, sf_dir) -> DataFrame``.  Array outputs are joined to
strings and ordered outputs carry an explicit rank column, so results can be
compared order-insensitively with the SQL oracles in ``renown.plans.oracle``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions import text as tx
from renown.operators import classify as C
from renown.operators import entities as E
from renown.operators import relevance as R
from renown.operators import report as RP
from renown.operators import sections as S
from renown.operators import summarize as SM
from renown.operators import tagging as TG
from renown.llm.common import scratch, written
from renown.plans.strategy import any_of, cut_lineage
from renown.plans import fixtures as fx
from renown.session import ensure_checkpoint_dir

QUERIES: dict = {}
AS_OF_RECENT = "2026-06-30 00:00:00"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def jn(c, sep: str = "|"):
    return F.array_join(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), sep)


def _m(spark, sf):
    return fx.mentions_fx(spark, sf)


def fx_aliases(spark):
    return fx.aliases_fx(spark)


def fx_alias_keys():
    """Alias keys of the fixture alias dimension, as written."""
    return [fx.ALIAS_TOKENS[i % 12] for i in range(fx.N_COMPANIES)] + [a for a, _ in fx.EXTRA_ALIASES]


def fx_needles(spark, sf):
    return E.company_needles(_m(spark, sf).select("company"), fx_aliases(spark))


def scored_mentions(spark, sf) -> DataFrame:
    """Analyzable fixture mentions with rule crisis flags and bumped severity."""
    m = R.analyzable_mentions(_m(spark, sf))
    m = TG.with_crisis_flags(m)
    return m.withColumn("severity", TG.bump_severity("severity", "crisis_flags"))


# ------------------------------------------------------------ scalar functions

@query
def safe_text(spark: SparkSession, sf: str) -> DataFrame:
    m = _m(spark, sf)
    st = tx.safe_text("raw_text")
    return m.select("seq", F.length(st).alias("n_chars"), F.md5(st).alias("text_md5"), F.substring(st, -20, 20).alias("tail"))


@query
def format_date(spark, sf):
    m = _m(spark, sf)
    epoch = (F.lit(fx.FORUM_EPOCH0) + F.col("seq") * 3600).cast("double") + F.when(F.col("seq") % 4 == 0, F.lit(0.25)).otherwise(F.lit(0.0))
    return m.select("seq", tx.format_epoch(epoch).alias("iso_date"), F.coalesce(tx.format_epoch(F.lit(None)), F.col("date_raw")).alias("passthrough"))


def metric_text(seq) -> F.Column:
    s = lambda c: c.cast("string")
    return F.concat_ws(
        "; ",
        F.when(seq % 7 != 0, F.concat(F.lit("Rated "), s(seq % 5 + 1), F.lit("."), s(seq % 10), F.lit(" stars from "),
                                      F.format_number(seq * 37, 0), F.lit(" reviews"))),
        F.when(seq % 4 == 0, F.concat(F.lit("salary Rs. "), F.format_number(seq * 100, 0), F.lit(" - "), F.format_number(seq * 150, 0)))
        .when(seq % 4 == 1, F.concat(F.lit("LKR"), s(seq * 90))),
        F.concat(s(seq % 13), F.lit(".5K likes")),
        F.concat(F.format_number(seq * 11, 0), F.lit(" followers")),
        F.concat(s(seq % 50), F.lit("-"), s(seq % 50 + 10), F.lit(" employees")),
        F.concat(F.lit("aria "), s(seq % 5 + 1), F.lit(" star")),
        F.when(seq % 3 == 0, F.concat(s(seq % 5), F.lit(" out of 5"))),
        F.when(seq % 5 == 0, F.concat(F.lit('<span class="rating-big">'), s(seq % 5), F.lit(".2</span>"))),
    )


@query
def extract_metrics(spark, sf):
    m = _m(spark, sf).select("seq", metric_text(F.col("seq")).alias("t"))
    return m.select(
        "seq", tx.listing_stars("t").alias("stars"), tx.listing_review_count("t").alias("review_count"),
        tx.salary_info("t").alias("salary_info"), tx.likes_text("t").alias("likes"),
        tx.followers_text("t").alias("followers"), tx.employees_text("t").alias("employees"),
        tx.aria_stars("t").alias("aria_stars"), tx.snippet_rating("t").alias("rating"),
        tx.class_rating("t").alias("class_rating"))


@query
def canonical_urls(spark, sf):
    m = _m(spark, sf)
    s = F.col("seq").cast("string")
    li = F.concat(F.lit("https://www.google.com/url?q=https://www.linkedin.com/company/acme-"), s, F.lit("/about&sa=U"))
    fb = F.concat(F.lit("https://m.facebook.com/page"), s, F.when(F.col("seq") % 2 == 0, F.lit("?ref=x")).otherwise(F.lit("/posts")))
    return m.select("seq", tx.profile_url(li).alias("profile_url"), tx.page_url(fb).alias("page_url"))


SITE_POOL = lx.NEWS_SITES + ["example.org"]


def _site_url(seq):
    return F.concat(F.lit("https://www."), F.element_at(F.array(*[F.lit(x) for x in SITE_POOL]), (seq % 10 + 1).cast("int")),
                    F.lit("/news/"), seq.cast("string"))


@query
def source_site(spark, sf):
    m = _m(spark, sf)
    return m.select("seq", tx.source_site(_site_url(F.col("seq"))).alias("source_site"))


def _review_text(seq, raw):
    s = seq.cast("string")
    return (F.when(seq % 4 == 0, F.concat(F.lit("Pros good pay "), s, F.lit(" Cons long hours Cons again")))
            .when(seq % 4 == 1, F.concat(F.lit("Great Pros team Pros culture "), s, F.lit(" Cons none")))
            .when(seq % 4 == 2, F.concat(F.lit("Only Pros here "), s))
            .otherwise(F.substring(raw, 1, 60)))


@query
def pros_cons(spark, sf):
    m = _m(spark, sf)
    pc = tx.pros_cons(_review_text(F.col("seq"), F.col("raw_text")))
    return m.select("seq", pc["pros"].alias("pros"), pc["cons"].alias("cons"), pc["text"].alias("review_text"))


@query
def export_manifest(spark, sf):
    c = _m(spark, sf).select("company").distinct()
    stamp = F.date_format(F.to_timestamp(F.lit(fx.AS_OF)), "yyyyMMdd_HHmmss")
    return c.select("company", F.concat(F.replace(F.lower("company"), F.lit(" "), F.lit("_")), F.lit("_"), stamp).alias("file_stem"))


# ------------------------------------------------------------------ entities

@query
def normalize_company(spark, sf):
    m = _m(spark, sf)
    names = m.select("seq", F.concat(F.lit("  "), F.element_at(F.array(
        F.lower("company"), F.upper("company"), F.lit("99X"), F.lit("mit"), F.lit("  people's  bank 99x o-neil wso2 "),
        F.element_at(F.array(*[F.lit(a) for a in fx.ALIAS_TOKENS]), (F.col("seq") % 12 + 1).cast("int")),
        F.substring("raw_text", 1, 12)), (F.col("seq") % 7 + 1).cast("int")), F.lit("\t")).alias("raw_name"))
    return E.normalize_company(names, "raw_name", fx_aliases(spark)).select("seq", "company")


@query
def company_needles(spark, sf):
    n = fx_needles(spark, sf)
    return n.select("company", jn("needles").alias("needles"))


@query
def mentions_company(spark, sf):
    m = E.with_needles(_m(spark, sf), fx_needles(spark, sf))
    return m.select("seq", "company", E.mentions_any("raw_text", "needles").alias("in_text"),
                    E.mentions_any("source_url", "needles").alias("in_url"))


@query
def tag_companies(spark, sf):
    m = _m(spark, sf).select("seq", "raw_text")
    return E.tag_companies(m, fx_needles(spark, sf))


@query
def tag_companies_indexed(spark, sf):
    """The same join through the gram index, as for needles by the thousand."""
    m = _m(spark, sf).select("seq", "raw_text")
    return E.tag_companies(m, fx_needles(spark, sf), few=0)


@query
def enriched_queries(spark, sf):
    return E.enriched_queries(_m(spark, sf).select("company")).select("company", "platform_ord", "platform", "query")


# ----------------------------------------------------------------- relevance

@query
def relevance_filter(spark, sf):
    return R.relevance_filter(_m(spark, sf), fx_needles(spark, sf), fx_alias_keys()).select("seq", "company")


@query
def geo_filter(spark, sf):
    return R.geo_filter(_m(spark, sf)).select("seq", "company")


@query
def validated_mentions(spark, sf):
    return R.validated_mentions(_m(spark, sf), fx_needles(spark, sf), fx_alias_keys()).select("seq", "company", "source_platform")


@query
def recent_mentions(spark, sf):
    m = _m(spark, sf).withColumn("event_ts", F.to_timestamp("date_raw"))
    return R.recent_mentions(m, AS_OF_RECENT).select("seq", "company")


@query
def analyzable_mentions(spark, sf):
    return R.analyzable_mentions(_m(spark, sf)).select("seq", "company")


@query
def pipeline_funnel(spark, sf):
    return R.pipeline_funnel(_m(spark, sf), fx_needles(spark, sf), fx_alias_keys())


# ------------------------------------------------------------------- tagging

@query
def regulatory_tags(spark, sf):
    return _m(spark, sf).select("seq", jn(TG.regulatory_tags("raw_text")).alias("regulatory"))


@query
def crisis_tags(spark, sf):
    return TG.with_crisis_flags(_m(spark, sf)).select("seq", jn("crisis_flags").alias("crisis_flags"))


# ------------------------------------------------------------ classification

def fx_classified(spark, sf):
    return C.classified_mentions(_m(spark, sf), fx.responses_fx(spark, sf))


@query
def parse_responses(spark, sf):
    p = C.parse_responses(fx.responses_fx(spark, sf))
    return p.select("seq", "parse_status", F.col("p_sentiment").alias("sentiment"), F.col("p_confidence").alias("confidence"),
                    F.col("p_reviewer_type").alias("reviewer_type"), jn("p_themes").alias("themes"),
                    F.col("p_severity").alias("severity"), F.col("p_language").alias("language_detected"))


@query
def classified_mentions(spark, sf):
    c = fx_classified(spark, sf)
    return c.select("seq", "company", "sentiment", "confidence", "reviewer_type", jn("themes").alias("themes"),
                    "severity", "language_detected", jn("crisis_flags").alias("crisis_flags"), "analysis_error")


@query
def classify_prompts(spark, sf):
    p = C.classify_prompts(_m(spark, sf))
    return p.select("seq", F.length("prompt").alias("prompt_len"), F.md5("prompt").alias("prompt_md5"))


@query
def summary_prompts(spark, sf):
    p = SM.summary_prompts(R.analyzable_mentions(_m(spark, sf)))
    return p.select("company", "n_lines", F.length("prompt").alias("prompt_len"), F.md5("prompt").alias("prompt_md5"))


def summary_responses_fx(spark, sf):
    """One simulated summary response per company, derived from the data."""
    g = _m(spark, sf).groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("k"))
    k = F.col("k")
    obj = F.concat(
        F.lit('{"what_employees_say": "emp '), k.cast("string"), F.lit('", "what_customers_say": "cust", '),
        F.lit('"top_5_pros": ["pay", "team"], "top_5_cons": ["hours"], "crisis_flags": ["Summary flag"], '),
        F.lit('"recommendation": "watch", "overall_score": '), ((F.col("n") * 7) % 101).cast("string"), F.lit("}"))
    r = (F.when(k % 4 == 0, F.lit("not json")).when(k % 4 == 1, F.concat(F.lit("```\n"), obj, F.lit("\n```")))
         .when(k % 4 == 2, F.lit("[]")).otherwise(obj))
    return g.select("company", r.alias("response"))


@query
def parse_summaries(spark, sf):
    p = SM.parse_summaries(summary_responses_fx(spark, sf))
    return p.select("company", *SM.SUMMARY_TEXT_FIELDS, *[jn(f).alias(f) for f in SM.SUMMARY_LIST_FIELDS], "overall_score", "summary_status")


@query
def company_crisis_flags(spark, sf):
    c = scored_mentions(spark, sf)
    f = SM.company_crisis_flags(c, SM.parse_summaries(summary_responses_fx(spark, sf)))
    return f.select("company", jn("crisis_flags").alias("crisis_flags"))


@query
def mention_roundtrip(spark, sf):
    m = _m(spark, sf).select("seq", "source_platform", "source_url", "raw_text", F.col("date_raw").alias("date"),
                             "rating", "reviewer_type", "metadata")
    js = m.select("seq", F.to_json(F.struct(F.col("*"), F.lit(1).alias("unknown_key"))).alias("js"))
    schema = "seq bigint, source_platform string, source_url string, raw_text string, date string, rating double, reviewer_type string, metadata " + fx.METADATA_TYPE.simpleString()
    back = js.select(F.from_json("js", schema).alias("r")).select("r.*")
    return back.select("seq", "source_platform", "source_url", F.md5("raw_text").alias("text_md5"), "date", "rating",
                       "reviewer_type", F.col("metadata.pros").alias("pros"), F.col("metadata.review_count").alias("review_count"))


# --------------------------------------------------------------- aggregates

@query
def source_counts(spark, sf):
    return S.source_counts(_m(spark, sf))


@query
def sentiment_breakdown(spark, sf):
    return S.sentiment_breakdown(_m(spark, sf))


@query
def sentiment_share(spark, sf):
    return S.sentiment_share(_m(spark, sf)).select(
        "company", "source_platform", *[F.round(F.col(f"{s}_pct"), 9).alias(f"{s}_pct") for s in ("positive", "negative", "neutral")])


@query
def sentiment_by_reviewer(spark, sf):
    return S.sentiment_by_reviewer(_m(spark, sf))


@query
def top_themes(spark, sf):
    return S.top_themes(_m(spark, sf))


@query
def avg_rating(spark, sf):
    return S.avg_rating(_m(spark, sf))


@query
def sample_quotes(spark, sf):
    return S.sample_quotes(_m(spark, sf)).select("company", "source_platform", "quote_rank", F.md5("quote").alias("quote_md5"),
                                                  F.length("quote").alias("quote_len"))


@query
def source_urls(spark, sf):
    return S.source_urls(_m(spark, sf))


@query
def company_scorecard(spark, sf):
    return RP.company_scorecard(scored_mentions(spark, sf))


# ------------------------------------------------------------------ sections

def flat_section(df: DataFrame) -> DataFrame:
    """Arrays -> joined strings (articles as '~'-joined fields)."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if f.name in ("articles", "latest_articles"):
            cols.append(F.array_join(F.transform(f.name, lambda a: F.concat_ws(
                "~", a["headline"], a["source"], F.coalesce(a["date"], F.lit("")), a["sentiment"], a["url"])), "|").alias(f.name))
        elif t.startswith("array"):
            cols.append(jn(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _section_query(platform):
    def fn(spark, sf):
        return flat_section(S.section(scored_mentions(spark, sf), platform))
    return fn


for _name, _plat in [("section_forum", "reddit"), ("section_maps", "google_maps"), ("section_employee", "glassdoor"),
                     ("section_jobs", "topjobs"), ("section_profile", "linkedin"), ("section_social", "facebook"),
                     ("section_news", "news"), ("section_web", "web")]:
    _f = _section_query(_plat)
    _f.__name__ = _name
    QUERIES[_name] = _f


def fx_report(spark, sf):
    from renown.plans.strategy import materialize
    # read by the scorecard, the section aggregates and the flag union
    c = materialize(RP.report_input(scored_mentions(spark, sf)))
    summ = SM.parse_summaries(summary_responses_fx(spark, sf))
    flags = SM.company_crisis_flags(c, summ)
    return RP.company_report(c, summ, flags, model_used="external", generated_at=fx.AS_OF.replace(" ", "T"))


@query
def company_report(spark, sf):
    r = fx_report(spark, sf)
    n_sections = sum(F.when(F.col(f"by_source.{k}").isNotNull(), 1).otherwise(0) for k in lx.SECTION_KEYS.values())
    a = "aggregated_summary"
    return r.select("company", "overall_score", "score_band", "total_results", n_sections.alias("n_sections"),
                    F.col(f"{a}.what_employees_say").alias("what_employees_say"),
                    F.col(f"{a}.what_press_says").alias("what_press_says"),
                    F.col(f"{a}.recommendation").alias("recommendation"),
                    jn(f"{a}.top_5_pros").alias("top_5_pros"), jn(f"{a}.crisis_flags").alias("crisis_flags"),
                    F.col("by_source.reddit.result_count").alias("reddit_count"),
                    F.col("by_source.sl_news.result_count").alias("news_count"))


@query
def export_report_json(spark, sf):
    from renown.sources.exports import report_json
    return report_json(fx_report(spark, sf))


@query
def export_report_lines(spark, sf):
    from renown.sources.exports import report_lines
    return report_lines(fx_report(spark, sf))


# --------------------------------------------------------------------- views

from renown.operators import views as V  # noqa: E402


@query
def labelled_mentions(spark, sf):
    v = V.labelled_mentions(scored_mentions(spark, sf))
    return v.select("seq", "company", "source_url", "sentiment", "badge", "date_short",
                    jn("theme_labels", ", ").alias("theme_labels"), "severity_label")


@query
def source_tab_rows(spark, sf):
    return V.source_tab_rows(scored_mentions(spark, sf)).select("seq", "company", "source_platform", "section_key")


def _view(name, fn):
    def q_(spark, sf):
        return fn(scored_mentions(spark, sf)).select("company", "source_platform", "view_rank", "seq")
    q_.__name__ = name
    QUERIES[name] = q_


_view("view_recent", V.view_recent)
_view("view_negative", V.view_negative)
_view("view_positive", V.view_positive)
_view("view_severity", V.view_severity)


@query
def export_csv_rows(spark, sf):
    c = scored_mentions(spark, sf)
    e = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    return c.select("seq", e("source_platform").alias("source_platform"), e("source_url").alias("source_url"),
                    e("sentiment").alias("sentiment"), e("confidence").alias("confidence"),
                    e("reviewer_type").alias("reviewer_type"), jn("themes", "; ").alias("themes"),
                    e("severity").alias("severity"), e("language_detected").alias("language"),
                    e("date_raw").alias("date"), F.md5(e("raw_text")).alias("raw_text_md5"))


# --------------------------------------------------------------------- dedup

from renown.operators import dedup as D  # noqa: E402

SEMANTIC_T = 0.35


@query
def dedup_fingerprint(spark, sf):
    return D.dedup_fingerprint(fx.documents_one_company(spark, sf)).select("company", "seq")


@query
def near_dup_pairs(spark, sf):
    p = D.near_dup_pairs(fx.vectors_fx(spark, sf), SEMANTIC_T)
    return p.select("company", "a", "b", F.round("sim", 6).alias("sim"))


@query
def dedup_semantic(spark, sf):
    return D.dedup_semantic(fx.vectors_fx(spark, sf), SEMANTIC_T).select("company", "seq")


from renown.operators import similarity as SIM  # noqa: E402


@query
def text_vectors(spark, sf):
    """Entries of the text vectors that are not zero."""
    v = SIM.text_vectors(fx.documents_one_company(spark, sf))
    return v.select("company", "seq", F.posexplode("embedding").alias("dim", "value")).where(F.col("value") != 0)


@query
def near_dup_candidates(spark, sf):
    with scratch(spark) as keep:
        v = keep(written(SIM.text_vectors(fx.documents_one_company(spark, sf))))
    return SIM.near_dup_candidates(v).withColumn("sim", F.round("sim", 6))


@query
def dedup_text(spark, sf):
    return SIM.dedup_text(fx.documents_one_company(spark, sf))


# ---------------------------------------------------------------------- caps

from renown.operators import caps as CP  # noqa: E402


@query
def capped_mentions(spark, sf):
    return CP.capped_mentions(_m(spark, sf)).select("company", "source_platform", "seq", "cap_rank")


def forum_post_rows(spark, sf):
    """Posts from the landed forum payloads with their kept-comment counts."""
    from renown.sources import forum as FO
    land = fx.landing_forum_fx(spark, sf)
    posts = FO.extract_posts(land.where(F.col("endpoint") == "search"))
    comments = FO.extract_comments(land.where(F.col("endpoint") == "comments"))
    n = comments.groupBy("company", "conv_id").agg(F.count(F.lit(1)).alias("n_comments"))
    return posts.join(n, ["company", "conv_id"], "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))


@query
def capped_threads(spark, sf):
    p = forum_post_rows(spark, sf).select("company", F.col("conv_id").alias("seq"), "n_comments")
    return CP.capped_threads(p, lx.FORUM_SOFT_CAP).select("company", "seq", "n_comments", "rows_before")


@query
def capped_threads_10(spark, sf):
    p = forum_post_rows(spark, sf).select("company", F.col("conv_id").alias("seq"), "n_comments")
    return CP.capped_threads(p, 10).select("company", "seq", "n_comments", "rows_before")


def _tiered(spark, sf):
    """Mentions of two companies in three tiers: groups over every platform's cap."""
    company = F.concat(F.lit("Group "), (F.floor(F.col("seq") / 8) % 2).cast("string"))
    return _m(spark, sf).withColumns({"tier": (F.col("seq") * 7 % 3).cast("int"), "company": company})


@query
def source_cascade(spark, sf):
    m = _tiered(spark, sf)
    web = CP.cascade_first_nonempty(m.where(F.col("source_platform") == "web"), keys=("company",))
    news = CP.cascade_fill(m.where(F.col("source_platform") == "news"), lx.PLATFORM_CAPS["news"])
    emp = CP.cascade_fill(m.where(F.col("source_platform") == "glassdoor"), lx.PLATFORM_CAPS["glassdoor"])
    cols = ["company", "source_platform", "seq", "tier"]
    return web.select(*cols).unionByName(news.select(*cols)).unionByName(emp.select(*cols))


@query
def fetch_plan(spark, sf):
    from renown.operators import snapshots as SN
    snaps = fx.snapshots_fx(spark, sf)
    fresh = SN.snapshot_fresh(SN.snapshot_latest(snaps), fx.AS_OF)
    comps = snaps.select("company").distinct()
    # the source list is a fixed literal, so the grid is a per-row inline, not a join
    grid = comps.select("company", F.inline(F.array(*[F.struct(F.lit(x).alias("source")) for x in fx.SNAPSHOT_SOURCES])))
    return SN.fetch_plan(grid, fresh)


# ----------------------------------------------------------------- snapshots

from renown.operators import snapshots as SN  # noqa: E402

SPLIT_TS = "2024-01-15 00:00:00"


@query
def snapshot_latest(spark, sf):
    return SN.snapshot_latest(fx.snapshots_fx(spark, sf))


@query
def snapshot_upsert(spark, sf):
    s = fx.snapshots_fx(spark, sf)
    old = s.where(F.col("cached_at") < F.to_timestamp(F.lit(SPLIT_TS)))
    new = s.where(F.col("cached_at") >= F.to_timestamp(F.lit(SPLIT_TS)))
    return SN.snapshot_upsert(old, new)


@query
def snapshot_fresh(spark, sf):
    return SN.snapshot_fresh(SN.snapshot_latest(fx.snapshots_fx(spark, sf)), fx.AS_OF)


@query
def snapshot_age(spark, sf):
    return SN.snapshot_age(SN.snapshot_latest(fx.snapshots_fx(spark, sf)), fx.AS_OF).select("company", "source", "age_text")


@query
def snapshot_clear(spark, sf):
    s = fx.snapshots_fx(spark, sf)
    # clear requests: every company that logged an 'error' event worth more than 300
    req = s.join(fx.table(spark, sf, "events").where((F.col("event_type") == "error") & (F.col("value") > 300))
                 .select(F.col("event_id").alias("seq")), "seq", "left_semi").select(F.upper("company").alias("company"))
    return SN.snapshot_clear(s, req).select("company", "source", "seq")


@query
def usage_totals(spark, sf):
    return SN.usage_totals(fx.usage_fx(spark, sf))


from renown.operators import store as ST  # noqa: E402

REPORT_JSON = "tokens long, kinds long"


def _in_store(spark, run) -> DataFrame:
    """Result of ``run(root)`` on a store of its own in the shared folder,
    which goes once the result is checkpointed."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    try:
        return cut_lineage(run(root))
    finally:
        ST.Folders(spark, root).remove()


@query
def snapshot_store(spark, sf):
    """Two batches are written, one is replayed, the store is compacted, a
    third batch and a replay of the first follow; fresh rows are read."""
    s = fx.snapshots_fx(spark, sf)
    part = F.pmod(F.col("seq"), F.lit(3))

    def run(root):
        for i in (0, 1, 0):
            ST.write_batch(s.where(part == i), root, f"b{i}")
        ST.compact(spark, root)
        for i in (2, 0):
            ST.write_batch(s.where(part == i), root, f"b{i}")
        return ST.fresh_store(spark, root, fx.AS_OF)
    return _in_store(spark, run)


@query
def cached_reports(spark, sf):
    """Per user and model a report snapshot is written; the newest of a
    user, whatever the model, is read back while it is fresh."""
    u = fx.usage_fx(spark, sf)
    per = u.groupBy("company", "model").agg(F.sum("tokens_used").alias("tokens"), F.count_distinct("provider").alias("kinds"),
                                            F.max("run_at").alias("cached_at"))
    rows = per.select(F.upper("company").alias("company"), F.col("model").alias("source"), "cached_at",
                      F.to_json(F.struct("tokens", "kinds")).alias("payload"), F.col("tokens").alias("seq"))

    def run(root):
        ST.write_batch(rows, root, "reports")
        ST.compact(spark, root)
        r = ST.read_reports(spark, root, fx.AS_OF, REPORT_JSON)
        return r.select("company", "model_used", "report.tokens", "report.kinds")
    return _in_store(spark, run)


@query
def usage_ledger(spark, sf):
    """Runs (one a day) are recorded in two jobs, the first is replayed."""
    u = fx.usage_fx(spark, sf).withColumn("run_id", F.date_format("run_at", "yyyyMMdd"))
    early = F.col("run_at") < F.to_timestamp(F.lit(SPLIT_TS))

    def run(root):
        ST.record_usage(u.where(early), root)
        ST.record_usage(u.where(~early), root)
        ST.record_usage(u.where(early), root)
        return ST.recorded_totals(spark, root)
    return _in_store(spark, run)


# ------------------------------------------------------------------- sources

from renown.sources import forum as FO  # noqa: E402
from renown.sources import html as HT  # noqa: E402
from renown.sources import websearch as WS  # noqa: E402

AS_OF_FORUM = "2026-01-15 00:00:00"


def fx_threads(spark, sf):
    land = fx.landing_forum_fx(spark, sf)
    return FO.taken_threads(FO.extract_posts(land.where(F.col("endpoint") == "search"), as_of=AS_OF_FORUM),
                            FO.extract_comments(land.where(F.col("endpoint") == "comments")))


@query
def src_forum_posts(spark, sf):
    p, _ = fx_threads(spark, sf)
    return p.select("company", "conv_id", "post_pos", "source_url", F.md5("raw_text").alias("text_md5"),
                    F.length("raw_text").alias("text_len"), "date_raw", "score", "num_comments", "subreddit")


@query
def src_forum_comments(spark, sf):
    _, c = fx_threads(spark, sf)
    return c.select("company", "conv_id", "comment_pos", "source_url", F.md5("raw_text").alias("text_md5"), "date_raw", "score",
                    "parent_post", "reviewer_type")


@query
def src_web_results(spark, sf):
    r = WS.extract_results(fx.landing_web_fx(spark, sf))
    return r.select("company", "grp", "result_pos", "source_url", F.md5("raw_text").alias("text_md5"), "title",
                    "score", F.coalesce("position", F.lit(0)).alias("position"), "search_engine")


@query
def all_mentions(spark, sf):
    posts, comments = fx_threads(spark, sf)
    web = WS.extract_results(fx.landing_web_fx(spark, sf))
    common = ["company", "source_platform", "source_url", "raw_text"]
    parts = [posts.select(*common, F.col("conv_id").alias("position"), F.lit(0).alias("item")),
             comments.select(*common, F.col("conv_id").alias("position"), (F.col("comment_pos") + 1).alias("item")),
             web.select(*common, F.col("grp").alias("position"), F.col("result_pos").alias("item"))]
    u = CP.all_mentions(parts)
    return u.select("company", "source_platform", "seq.platform_ord", "seq.position", "seq.item", "source_url", F.md5("raw_text").alias("text_md5"))


@query
def html_elements(spark, sf):
    el = HT.html_elements(fx.table(spark, sf, "pages"), tags=("div",))
    ads = el.where((F.col("tag") == "div") & (F.col("cls") == "ad"))
    from pyspark.sql import Window
    w = Window.partitionBy("page_id").orderBy("pos")
    return ads.select("page_id", F.row_number().over(w).alias("ad_index"), "text")


@query
def html_element_counts(spark, sf):
    """Every element of every page, counted by tag (and those with a class)."""
    el = HT.html_elements(fx.table(spark, sf, "pages"))
    return el.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.count("cls").alias("n_class"))


@query
def src_job_cards(spark, sf):
    """Job-card layout B over the pages."""
    el = HT.html_elements(fx.table(spark, sf, "pages"), tags=("li", "div", "a"))
    return PG.job_cards_b(el).drop("source_platform")


# ------------------------------------------------------------- page sources

from renown.sources import pages as PG  # noqa: E402

def fx_page_elements(spark, sf):
    """Pages and their element table; the element table is parsed once and
    materialized, because every extractor reads it several times."""
    from renown.plans.strategy import materialize
    w = fx.wrapped_pages_fx(spark, sf)
    el = HT.html_elements(w)
    return w, materialize(el.join(w.select("page_id", "company"), "page_id"))


@query
def src_map_listing(spark, sf):
    w = fx.wrapped_pages_fx(spark, sf)
    return PG.map_listing(w).select("page_id", "company", "raw_text", "rating", "review_count")


@query
def src_map_reviews(spark, sf):
    _, el = fx_page_elements(spark, sf)
    return PG.map_reviews(el).select("page_id", "review_index", "raw_text", "rating")


@query
def src_employee_reviews(spark, sf):
    w, el = fx_page_elements(spark, sf)
    r = PG.employee_review_cascade(PG.employee_reviews(el, w), PG.secondary_employee_reviews(el))
    return r.select("page_id", "cascade_rank", "tier", "raw_text", "rating", "pros", "cons", "source_site")


@query
def src_job_listings(spark, sf):
    _, el = fx_page_elements(spark, sf)
    return PG.job_listings(el).select("page_id", "item_rank", "raw_text", "salary_info")


@query
def src_job_cards_c(spark, sf):
    _, el = fx_page_elements(spark, sf)
    return PG.job_cards_c(el).select("page_id", "item_rank", "raw_text")


@query
def src_careers_text(spark, sf):
    w, el = fx_page_elements(spark, sf)
    t = PG.careers_text(el, w)
    return t.select("page_id", "source_url", F.length("raw_text").alias("text_len"))


@query
def src_careers_link(spark, sf):
    w, el = fx_page_elements(spark, sf)
    return PG.careers_link(el, w).select("page_id", "careers_url")


@query
def src_profiles(spark, sf):
    _, el = fx_page_elements(spark, sf)
    links = PG.profile_links(el)
    cards = PG.profile_cards(el, links)
    a = links.select("page_id", F.lit(0).alias("tier"), "item_rank", "source_url", "raw_text", "followers", "employees")
    b = cards.select("page_id", F.lit(1).alias("tier"), "item_rank", F.lit("").alias("source_url"), "raw_text",
                     F.lit(None).cast("string").alias("followers"), F.lit(None).cast("string").alias("employees"))
    return a.unionByName(b)


@query
def src_social_pages(spark, sf):
    _, el = fx_page_elements(spark, sf)
    return PG.social_pages(el).select("page_id", "item_rank", "source_url", "raw_text", "rating", "likes")


@query
def src_news_articles(spark, sf):
    _, el = fx_page_elements(spark, sf)
    return PG.news_articles(el).select("page_id", "item_rank", "source_url", "raw_text", "date_raw", "headline", "source_site")


@query
def src_news_links(spark, sf):
    _, el = fx_page_elements(spark, sf)
    arts = PG.news_articles(el)
    links = PG.news_links(el, already=arts)
    return PG.news_cascade(arts, links).select("company", "page_id", "cascade_rank", "tier", "source_url", "headline", "source_site")


@query
def src_web_html(spark, sf):
    _, el = fx_page_elements(spark, sf)
    return PG.web_result_blocks(el).select("page_id", "source_url", "raw_text", "title")



@query
def cache_hits(spark, sf):
    """Per company: sources served from a fresh snapshot, sources to fetch,
    and the cache-hit ratio (the funnel's cache line)."""
    plan = QUERIES["fetch_plan"](spark, sf)
    g = plan.groupBy("company").agg(F.count_if(F.col("action") == "cached").alias("cached"),
                                    F.count_if(F.col("action") == "fetch").alias("to_fetch"))
    return g.withColumn("hit_ratio", F.round(F.col("cached") / (F.col("cached") + F.col("to_fetch")), 6))


@query
def src_web_cascade(spark, sf):
    """Web results per company: the second search layout is used only when
    the first gave nothing, the HTML results only when both gave nothing;
    the result is cut to the web cap in (tier, position) order."""
    from pyspark.sql import Window
    r = WS.extract_results(fx.landing_web_fx(spark, sf))
    api = r.select("company", F.when(F.col("search_engine") == "engine_a", 0).otherwise(1).alias("tier"),
                   (F.col("grp") * 10 + F.col("result_pos")).alias("seq"), "source_url")
    _, el = fx_page_elements(spark, sf)
    html = PG.web_result_blocks(el).join(el.select("page_id", "company").distinct(), "page_id").select(
        "company", F.lit(2).alias("tier"), F.col("page_id").alias("seq"), "source_url")
    first = CP.cascade_first_nonempty(api.unionByName(html), "tier")
    w = Window.partitionBy("company").orderBy("tier", "seq")
    return first.withColumn("web_rank", F.row_number().over(w)).where(F.col("web_rank") <= lx.PLATFORM_CAPS["web"])


# ------------------------------------------------------------- end-to-end run

from renown.plans import end_to_end as EE  # noqa: E402
from renown.sources import canonical as CN  # noqa: E402


def fx_canonical(spark, sf) -> DataFrame:
    """Canonical mentions of the eight platforms, from landed payloads."""
    from renown.plans.strategy import materialize
    w, el = fx_page_elements(spark, sf)
    plain = fx.table(spark, sf, "pages")
    cards = materialize(HT.html_elements(plain, tags=("li", "div", "a")).join(
        plain.select("page_id", fx.company_name(F.col("page_id") % fx.N_COMPANIES).alias("company")), "page_id"))
    blocks = PG.web_result_blocks(el).join(w.select("page_id", "company"), "page_id")
    return CN.canonical_union([*CN.forum_mentions(*fx_threads(spark, sf)), *CN.page_mentions(w, el, cards),
                               CN.web_mentions(WS.extract_results(fx.landing_web_fx(spark, sf)), blocks)])


def run_responses(mentions: DataFrame) -> DataFrame:
    """Landed classifier responses of a run: some missing, some malformed."""
    p = F.col("seq.position")
    text = F.concat(F.lit('{"sentiment": "'), F.element_at(F.array(*[F.lit(x) for x in lx.SENTIMENTS]), (p % 3 + 1).cast("int")),
                    F.lit('", "confidence": 0.5, "themes": ["'), F.element_at(F.array(*[F.lit(x) for x in lx.THEMES]), (p % 12 + 1).cast("int")),
                    F.lit('"], "severity": "low", "language_detected": "en"}'))
    return mentions.where(p % 50 != 7).select("seq", "company", F.when(p % 10 == 0, F.lit("not json")).otherwise(text).alias("response"))


@query
def canonical_mentions(spark, sf):
    m = fx_canonical(spark, sf)
    return m.select("company", "source_platform", "seq.platform_ord", "seq.position", "seq.item", "source_url", F.md5("raw_text").alias("text_md5"),
                    "date_raw", "rating", "reviewer_type", *[F.col(f"metadata.{f}").alias(f"m_{f}") for f in (
                        "type", "pros", "salary_info", "followers", "likes", "headline", "title", "parent_post")])


@query
def pipeline_report(spark, sf):
    """The whole run: funnel and report header per company."""
    summaries = SM.parse_summaries(summary_responses_fx(spark, sf))
    funnel, report = EE.run_report(fx_canonical(spark, sf), fx_needles(spark, sf), run_responses, summaries, fx_alias_keys(),
                                   fx.AS_OF.replace(" ", "T"))
    n_sections = sum(F.when(F.col(f"by_source.{k}").isNotNull(), 1).otherwise(0) for k in lx.SECTION_KEYS.values())
    r = report.select("company", "overall_score", "score_band", "total_results", n_sections.alias("n_sections"),
                      F.coalesce("by_source.topjobs_ikman.result_count", F.lit(0)).alias("jobs"),
                      F.coalesce("by_source.web_general.positive", F.lit(0)).alias("web_positive"),
                      jn("by_source.topjobs_ikman.urls").alias("job_urls"), jn("aggregated_summary.crisis_flags").alias("crisis_flags"))
    return funnel.join(r, "company", "left")
