"""Relevance, geography, recency and length filters, plus the stage funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import col_, py_strip, url_host
from renown.operators.entities import ends_with_any, mentions_any, with_needles
from renown.functions.matcher import lexicon_hits


def geo_predicate(text, url, keywords=None, suffix: str = lx.GEO_DOMAIN_SUFFIX, lowered: bool = False) -> Column:
    """url authority ends with the country suffix, or lower(text) contains a
    geography keyword (``lowered``: the text column is already lower-case)."""
    keywords = keywords or lx.GEO_KEYWORDS
    host = F.coalesce(url_host(url), F.lit(""))
    return host.endswith(suffix) | (F.size(lexicon_hits(text, keywords)) > 0)


def relevance_predicate(text="_lt", url="_lu", needles="needles", alias_keys=None) -> Column:
    """Text mentions the company (or one of its aliases), or the url ends with
    an alias key, or the url mentions the company.  ``text``/``url`` are the
    lower-cased columns added by ``_with_lower``."""
    keys = [a for a, _ in lx.COMPANY_ALIASES] if alias_keys is None else alias_keys
    return mentions_any(text, needles, lowered=True) | ends_with_any(url, keys) | mentions_any(url, needles, lowered=True)


def _with_lower(m: DataFrame) -> DataFrame:
    """Lower-case text and url once; the needle lambdas then read columns
    instead of lower-casing the whole text once per needle."""
    return (m.withColumn("_lt", F.lower(F.coalesce("raw_text", F.lit(""))))
            .withColumn("_lu", F.lower(F.coalesce("source_url", F.lit("")))))


def flag_stages(mentions: DataFrame, needles: DataFrame, alias_keys=None, native_platforms=("topjobs",)) -> DataFrame:
    """Add boolean stage columns: relevant, geo_ok, validated."""
    m = _with_lower(with_needles(mentions, needles))
    m = m.withColumn("relevant", relevance_predicate("_lt", "_lu", alias_keys=alias_keys))
    m = m.withColumn("geo_ok", geo_predicate("raw_text", "source_url")).drop("_lt", "_lu")
    m = m.withColumn("validated", F.col("relevant") & (F.col("source_platform").isin(*native_platforms) | F.col("geo_ok")))
    return m.drop("needles")


def relevance_filter(mentions: DataFrame, needles: DataFrame, alias_keys=None) -> DataFrame:
    m = _with_lower(with_needles(mentions, needles))
    return m.where(relevance_predicate("_lt", "_lu", alias_keys=alias_keys)).drop("needles", "_lt", "_lu")


def geo_filter(mentions: DataFrame) -> DataFrame:
    return mentions.where(geo_predicate("raw_text", "source_url"))


def validated_mentions(mentions: DataFrame, needles: DataFrame, alias_keys=None) -> DataFrame:
    return flag_stages(mentions, needles, alias_keys).where("validated").drop("relevant", "geo_ok", "validated")


def recent_mentions(mentions: DataFrame, as_of: str, max_age_days: int = lx.MAX_POST_AGE_DAYS,
                    ts_col: str = "event_ts") -> DataFrame:
    """Drop forum posts older than the cutoff; comments are not tested."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(max_age_days))
    is_post = (F.col("source_platform") == "reddit") & (F.col("metadata.type") == "post")
    return mentions.where(~is_post | F.col(ts_col).isNull() | (F.col(ts_col) >= cutoff))


def is_analyzable(text="raw_text", min_chars: int = 10) -> Column:
    t = col_(text)
    return t.isNotNull() & (F.length(py_strip(t)) >= min_chars)


def analyzable_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.where(is_analyzable())


def pipeline_funnel(mentions: DataFrame, needles: DataFrame, alias_keys=None) -> DataFrame:
    """One pass: per company raw, irrelevant, non-geo, validated, duplicate
    (exact fingerprint) and analyzable counts."""
    from renown.functions.text import fingerprint
    from renown.plans.strategy import materialize

    # whole-text work once, then a slim stage (no text) read by both branches
    st = flag_stages(mentions, needles, alias_keys)
    st = materialize(st.select("company", "seq", "relevant", "geo_ok", "validated",
                               fingerprint("raw_text").alias("_fp"), is_analyzable().alias("_ok")))
    keep = st.where("validated").groupBy("company", "_fp").agg(F.min("seq").alias("seq")).withColumn("survivor", F.lit(True))
    st = st.join(keep.select("company", "seq", "survivor"), ["company", "seq"], "left").withColumn(
        "survivor", F.coalesce("survivor", F.lit(False)))
    return st.groupBy("company").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(~F.col("relevant")).alias("irrelevant"),
        F.count_if(F.col("relevant") & ~F.col("validated")).alias("non_geo"),
        F.count_if("validated").alias("validated"),
        F.count_if(F.col("validated") & ~F.col("survivor")).alias("duplicates"),
        F.count_if(F.col("validated") & F.col("survivor") & F.col("_ok")).alias("analyzed"),
    )
