"""Ranked and labelled views of classified mentions, and tab routing."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx

KEYS = ["company", "source_platform"]


def map_lit(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def rank_by(ranks: dict, default: int, col: str) -> Column:
    return F.coalesce(F.try_element_at(map_lit(ranks), F.col(col)), F.lit(default))


def ranked(df: DataFrame, order: list[tuple[Column, bool]], keys=KEYS, out: str = "view_rank") -> DataFrame:
    """Explicit rank within each tab for ``order`` = [(expression,
    descending)], with ``seq`` as the final key, so the order is total and
    equals a stable sort of first-seen order.  Ranks are computed on a slim
    key table (range-partitioned, see ``rank_within_groups``) and joined back
    on (keys, seq), so no tab is sorted in a single task."""
    from renown.plans.strategy import rank_within_groups

    slim = df.select(*keys, "seq", *[e.alias(f"_o{i}") for i, (e, _) in enumerate(order)])
    sort = [F.col(f"_o{i}").desc() if desc else F.col(f"_o{i}").asc() for i, (_, desc) in enumerate(order)]
    r = rank_within_groups(slim, keys, [*sort, F.col("seq").asc()], out).select(*keys, "seq", out)
    return df.join(r, [*keys, "seq"])


def view_recent(df: DataFrame) -> DataFrame:
    return ranked(df, [(F.coalesce("date_raw", F.lit("")), True)])


def view_negative(df: DataFrame) -> DataFrame:
    r, d = lx.RANK_MOST_NEGATIVE
    return ranked(df, [(rank_by(r, d, "sentiment"), False)])


def view_positive(df: DataFrame) -> DataFrame:
    r, d = lx.RANK_MOST_POSITIVE
    return ranked(df, [(rank_by(r, d, "sentiment"), False)])


def view_severity(df: DataFrame) -> DataFrame:
    r, d = lx.RANK_SEVERITY
    d2 = df.withColumn("_sev", F.coalesce("severity", F.lit("low")))
    return ranked(d2, [(rank_by(r, d, "_sev"), False)]).drop("_sev")


def labelled_mentions(df: DataFrame) -> DataFrame:
    """Card projection: badge, first 10 chars of the date, theme labels,
    upper-case severity."""
    badge = F.coalesce(F.try_element_at(map_lit(lx.REVIEWER_BADGES), F.coalesce("reviewer_type", F.lit("general"))),
                       F.lit(lx.REVIEWER_BADGES["general"]))
    labels = map_lit(lx.THEME_LABELS)
    themes = F.transform(F.coalesce("themes", F.array().cast("array<string>")),
                         lambda t: F.coalesce(F.try_element_at(labels, t), t))
    return df.select(
        "company", "seq", "source_platform", F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"), badge.alias("badge"),
        F.substring(F.coalesce("date_raw", F.lit("")), 1, 10).alias("date_short"),
        themes.alias("theme_labels"), F.upper(F.coalesce("severity", F.lit("low"))).alias("severity_label"))


def source_tab_rows(df: DataFrame) -> DataFrame:
    """Route every mention to its report section key (the platform -> section
    mapping is a literal map: no join, no shuffle)."""
    return df.withColumn("section_key", F.coalesce(F.try_element_at(map_lit(lx.SECTION_KEYS), F.col("source_platform")),
                                                   F.col("source_platform")))
