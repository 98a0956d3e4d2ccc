"""Small physical-strategy helpers shared by operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only when it is proven to hold at most this many
# rows; above it the operator takes its partitioned path.
BROADCAST_MAX_ROWS = 50_000


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows (reads at most limit+1)."""
    return df.limit(limit + 1).count() <= limit




def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast a per-key lookup table only behind a row-count check, so the
    large side is never shuffled on a hot key; above the bound the planner's
    sort-merge join with AQE skew splitting is used."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def any_of(conds):
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds):
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def checkpoint_dir(df: DataFrame) -> str:
    from renown.session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(df.sparkSession)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the cluster's shared checkpoint folder, so a
    lost executor does not force recomputing earlier rounds."""
    checkpoint_dir(df)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage that several aggregates reuse once (compressed columns in
    the shared checkpoint folder) instead of recomputing its text work per
    consumer, which reads the columns it needs; lineage is cut, so executor
    loss re-reads the written data."""
    from renown.llm.common import written

    return written(df)


def rank_within_groups(df: DataFrame, keys, order, out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row inside its group under a total order,
    without sorting any group in a single task.

    Rows are range-partitioned on (keys, order) and sorted inside each
    partition, so a hot group is spread over many consecutive partitions.
    A row's rank is the number of rows of its group in earlier partitions
    (prefix sums over a small count table: groups x partitions) plus its
    position inside its own partition.  ``order`` must end with a unique
    column (e.g. ``seq``) so the order is total; the keyed row table is
    checkpointed so partition ids and positions are stable.
    """
    keys = list(keys)
    order = list(order)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = df.repartitionByRange(n, *[F.col(c) for c in keys], *order).sortWithinPartitions(*[F.col(c) for c in keys], *order)
    k = k.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.spark_partition_id())
    k = cut_lineage(k)
    from pyspark.sql import Window

    stats = k.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    r = k.join(offs.select(*keys, "_pid", "_before", "_first"), [*keys, "_pid"])
    return r.withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("long")).drop(
        "_mid", "_pid", "_before", "_first")
