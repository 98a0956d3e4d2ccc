"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renown.session import ensure_checkpoint_dir

BITMAP_BITS = 32768  # bits of one bitmap_construct_agg bitmap
MAX_FILTER_BITS = 1 << 27  # 16 MB: the largest key filter ever sent to tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _drop_folder(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is executed in the block go when it has ended, not
    when the driver's garbage is collected."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


_FOLDERS: dict[str, str] = {}
_TABLES: list[str] = []  # folders of the tables written, oldest first


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the folder that the cluster's
    executors share (``spark.checkpoint.dir``): cuts lineage, survives lost
    executors, and is smaller than a checkpoint.  The application's folder is
    deleted when the driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/renown-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop_folder, spark, _FOLDERS[app])
    path = f"{_FOLDERS[app]}/{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written in the block at its end, but for those passed
    to the function it gives, which frames built in the block still read."""
    first, kept = len(_TABLES), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.folder)
        return df

    try:
        yield keep
    finally:
        for path in _TABLES[first:]:
            if path not in kept:
                _drop_folder(spark, path)
        _TABLES[first:] = [path for path in _TABLES[first:] if path in kept]


def names(df: DataFrame, prefix: str, n: int = 1) -> list[str]:
    """``n`` column names that the table does not have (nor any table by chance)."""
    return [f"{prefix}_{uuid.uuid4().hex[:12]}" for _ in range(n)]


def quoted(columns) -> list:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def row_keys(docs: DataFrame) -> list:
    """Two 64-bit keys of a row's id and text: rows that differ in them share
    both only by a chance of about 1e-20 for 1e9 rows."""
    parts = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))]


MARK_CLASSES = 1 << 20


def marked_rows(keyed: DataFrame, keys: DataFrame, k1: str, k2: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose class of keys holds one of ``keys``, other rows).  Classes
    are a hash of the first key; at most ``MARK_CLASSES`` of them (16 MB) are
    broadcast, so most rows are passed on at the scan and only few
    texts beside the wanted ones take part in a join.  DataFrame functions only."""
    (name,) = names(keyed, "_class")
    of = lambda c: F.pmod(F.xxhash64(F.lit("class"), F.col(c)), F.lit(MARK_CLASSES))
    classes = F.broadcast(keys.select(of(k1).alias(name)).distinct())
    classed = keyed.withColumn(name, of(k1))
    return classed.join(classes, name, "left_semi").drop(name), classed.join(classes, name, "left_anti").drop(name)


def keep_share(key, n_rows: int, bound: int, salt: int = 0):
    """Condition that keeps about ``bound`` of ``n_rows`` rows, chosen by a
    hash of ``key`` (deterministic, independent of row order)."""
    if n_rows <= bound:
        return F.lit(True)
    share = int(bound / n_rows * 1_000_000_000)
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000_000)) < F.lit(share)


def key_filter(keys: DataFrame, col: str, n_keys: int, position=None) -> tuple[np.ndarray, int]:
    """One-hash membership bitmap of ``keys[col]`` as (bytes, bits).

    Thirty-two bits per key, at most MAX_FILTER_BITS (16 MB) in all: the size
    sent to the driver and to tasks is bounded; beyond it the filter only lets
    more rows through.  Callers must be right whatever false positives it lets
    through.  ``position(column, bits)`` is ``filter_position`` by default.
    """
    bits = BITMAP_BITS
    while bits < 32 * max(1, n_keys) and bits < MAX_FILTER_BITS:
        bits *= 2
    pos = (position or filter_position)(F.col(col), bits)
    rows = (keys.select(pos.alias("p")).groupBy(F.floor(F.col("p") / BITMAP_BITS).cast("long").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("p") % BITMAP_BITS).alias("bits")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = r["bucket"] * (BITMAP_BITS // 8)
        out[at:at + len(part)] = part
    return out, bits


def filter_position(col, bits: int):
    return F.pmod(F.xxhash64(col, F.lit(77)), F.lit(bits))


def in_filter(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b): (id, component) for every
    node with an edge to another, component = its smallest node id.

    Alternating large-star / small-star rounds; every round is two grouped
    minima joined back (partial aggregation, so a hub never gathers its
    neighbours in one task; the joins are splittable by AQE) and one written
    table.  Ends when every node points at its component's minimum.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            out = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            out.folder = e.folder
            return out
        seen = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        _drop_folder(e.sparkSession, last.folder)
