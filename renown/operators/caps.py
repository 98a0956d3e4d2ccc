"""Per-source caps, soft running caps and source cascades; platform union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.operators.views import map_lit


def capped_mentions(df: DataFrame, caps: dict | None = None) -> DataFrame:
    """Keep the first ``cap(platform)`` rows per (company, platform) by seq.

    A literal bound (the largest cap) is applied first so Spark plans a
    partial per-partition top-k before the shuffle; the per-platform bound
    then filters the survivors."""
    caps = caps or lx.PLATFORM_CAPS
    w = Window.partitionBy("company", "source_platform").orderBy("seq")
    r = df.withColumn("cap_rank", F.row_number().over(w)).where(F.col("cap_rank") <= max(caps.values()))
    cap = F.try_element_at(map_lit(caps), F.col("source_platform"))
    return r.where(cap.isNull() | (F.col("cap_rank") <= cap))


def capped_threads(posts: DataFrame, cap: int = lx.FORUM_SOFT_CAP) -> DataFrame:
    """Soft cap: take the next post while the rows taken so far (each post
    counts 1 + its kept comments) are below ``cap``.

    Every post adds at least one row, so at most ``cap`` posts per company
    can be taken: a literal top-``cap`` bounds each group before the running
    sum is evaluated.  posts: (company, seq, n_comments)."""
    w = Window.partitionBy("company").orderBy("seq")
    top = posts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    before = F.sum(1 + F.col("n_comments")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return top.withColumn("rows_before", F.coalesce(before, F.lit(0))).where(F.col("rows_before") < cap).drop("_r")


def cascade_first_nonempty(df: DataFrame, tier_col: str = "tier", keys=("company",)) -> DataFrame:
    """Use a later tier only when every earlier tier gave nothing: keep the
    rows of the smallest tier present per key (aggregate + join, no window)."""
    from renown.plans.strategy import broadcast_if_small

    m = broadcast_if_small(df.groupBy(*keys).agg(F.min(tier_col).alias("_min_tier")))
    return df.join(m, list(keys)).where(F.col(tier_col) == F.col("_min_tier")).drop("_min_tier")


def cascade_fill(df: DataFrame, cap: int, tier_col: str = "tier", keys=("company",)) -> DataFrame:
    """Append tiers in order until ``cap`` rows: a tier is consulted only when
    the rows before it number fewer than ``cap``; overall rank <= cap.  The
    literal cap bounds every group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(tier_col, "seq")
    return df.withColumn("fill_rank", F.row_number().over(w)).where(F.col("fill_rank") <= cap)


def all_mentions(parts: list[DataFrame], platforms=None) -> DataFrame:
    """Union of per-platform extracts in platform order.  ``seq`` is the order
    key (platform_ord, position, item): position of the payload within the
    platform, then of the row within the payload; a struct compares field by
    field, so no range of ids can overflow into the next platform."""
    platforms = platforms or lx.PLATFORMS
    ords = {p: i for i, p in enumerate(platforms)}
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    po = F.coalesce(F.try_element_at(map_lit(ords), F.col("source_platform")), F.lit(len(platforms)))
    return out.withColumn("seq", F.struct(po.cast("int").alias("platform_ord"), F.col("position").cast("long").alias("position"),
                                          F.col("item").cast("int").alias("item"))).drop("position", "item")
