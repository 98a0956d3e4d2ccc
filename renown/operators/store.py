"""Snapshots and usage as tables on shared storage that survive replays.

A batch has an id and writes a partition of its own; a job that is run again
(a lost driver, a retried task) replaces that partition and changes nothing.

* Snapshots: batches go to ``log/batch_id=.../bucket=...``.  ``compact`` folds
  log and base into a new base generation of one newest row per key and only
  then removes the batches it read; a crash in between leaves rows that the
  latest-wins read resolves the same way.
* Usage: each run's ledger rows and their sums per (provider, model) are two
  partitions; totals are sums over the small run sums, not over the ledger.

One writer at a time; readers may run beside it.  Paths must be on storage
that the driver and all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.operators.snapshots import cached_reports, snapshot_fresh, snapshot_key, snapshot_latest, usage_totals

BUCKETS = 16  # by company: a read or a clear of one company touches one bucket
STORED = "company string, source string, cached_at timestamp, payload string, seq long"
LEDGER = "run_id string, provider string, model string, tokens_used long, calls_made long"


class Folders:
    """Folders of a store through Spark's own file system (any URI it reads)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def complete(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{folder}/_SUCCESS"))

    def remove(self, folder: str = "") -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}" if folder else self.root), True)


def _bucket(company, buckets: int):
    return F.pmod(F.xxhash64(F.lower(company)), F.lit(buckets)).cast("int")


def _replace_partition(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


# ----------------------------------------------------------------- snapshots

def write_batch(batch: DataFrame, root: str, batch_id: str, buckets: int = BUCKETS) -> None:
    """Land a batch of snapshots (company, source, cached_at, payload, seq);
    empty payload lists are not stored.  The same id again replaces the batch,
    buckets that the new rows no longer touch included."""
    b = batch.where(~F.coalesce(F.col("payload"), F.lit("")).isin("", "[]"))
    b = b.select("company", "source", F.col("cached_at").cast("timestamp").alias("cached_at"), "payload", "seq",
                 _bucket("company", buckets).alias("bucket"))
    # a folder for the whole batch: overwriting it drops its old buckets as well
    b.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/log/batch_id={batch_id}")


def _base_generation(folders: Folders) -> int:
    return max((int(n.split("=")[1]) for n in folders.names("base") if folders.complete(f"base/{n}")), default=0)


def _batches(folders: Folders) -> list[str]:
    """Batches whose write ended; a half-written one waits for its replay."""
    return [f"log/{n}" for n in folders.names("log") if folders.complete(f"log/{n}")]


def _stored(folders: Folders, read: list[str]) -> DataFrame:
    if not read:
        return folders.spark.createDataFrame([], STORED + ", bucket int")
    parts = [folders.spark.read.schema(STORED + ", bucket int").parquet(f"{folders.root}/{f}") for f in read]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_store(spark: SparkSession, root: str, company: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Newest snapshot per (lower(company), lower(source)); ``company`` reads
    the one bucket that can hold it."""
    folders = Folders(spark, root)
    gen = _base_generation(folders)
    rows = _stored(folders, ([f"base/gen={gen}"] if gen else []) + _batches(folders))
    if company is not None:
        b = spark.range(1).select(_bucket(F.lit(company), buckets)).first()[0]
        rows = rows.where((F.col("bucket") == b) & (F.lower("company") == company.lower()))
    return snapshot_latest(rows.drop("bucket"))


def compact(spark: SparkSession, root: str, buckets: int = BUCKETS) -> int:
    """Fold base and log into the next base generation; returns its number.
    Only batches that were read are removed, so one that lands meanwhile stays."""
    folders = Folders(spark, root)
    gen, read = _base_generation(folders), _batches(folders)
    if not read:
        return gen
    rows = _stored(folders, ([f"base/gen={gen}"] if gen else []) + read).drop("bucket")
    k = snapshot_key(rows).groupBy("company_key", "source_key").agg(
        F.max_by(F.struct("company", "source", "cached_at", "payload", "seq"), F.struct("cached_at", "seq")).alias("r"))
    newest = k.select("r.*").withColumn("bucket", _bucket("company", buckets))
    (newest.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/base/gen={gen + 1}"))
    for f in read + [f"base/{n}" for n in folders.names("base") if int(n.split("=")[1]) <= gen]:
        folders.remove(f)
    return gen + 1


def fresh_store(spark: SparkSession, root: str, as_of: str, ttl_seconds: int = lx.SNAPSHOT_TTL_SECONDS) -> DataFrame:
    return snapshot_fresh(read_store(spark, root), as_of, ttl_seconds)


def read_reports(spark: SparkSession, root: str, as_of: str, schema: str, ttl_seconds: int = lx.SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Fresh reports of a store whose sources are model names: the newest of a
    company counts whatever model wrote it."""
    return cached_reports(read_store(spark, root), as_of, schema, ttl_seconds)


# --------------------------------------------------------------------- usage

def record_usage(usage: DataFrame, root: str) -> None:
    """Land the ledger rows of one or more runs (run_id, company, provider,
    model, tokens_used, calls_made, run_at) and the sums of those runs.  A run
    that is recorded again replaces its rows and sums."""
    _replace_partition(usage.withColumn("company", F.lower("company")), f"{root}/ledger", "run_id")
    sums = usage.groupBy("run_id", "provider", "model").agg(F.sum("tokens_used").alias("tokens_used"), F.sum("calls_made").alias("calls_made"))
    _replace_partition(sums.repartition("run_id"), f"{root}/sums", "run_id")


def recorded_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals per (provider, model) and the overall row, from the run sums."""
    return usage_totals(spark.read.schema(LEDGER).parquet(f"{root}/sums"))
