"""Time-limited snapshots (append-only, latest wins) and the usage ledger.

Writes are appends partitioned by source; reads pick the newest row per key
with a partial aggregate (``max_by``), so even a key holding a third of all
rows is combined map-side.  ``as_of`` is always a parameter: the wall clock
is never read inside a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx


def snapshot_key(df: DataFrame) -> DataFrame:
    return df.withColumn("company_key", F.lower("company")).withColumn("source_key", F.lower("source"))


def snapshot_latest(df: DataFrame) -> DataFrame:
    """Newest row per (lower(company), lower(source)); ties -> larger seq."""
    k = snapshot_key(df)
    g = k.groupBy("company_key", "source_key").agg(
        F.max_by(F.struct("cached_at", "payload", "seq"), F.struct("cached_at", "seq")).alias("r"))
    return g.select(F.col("company_key").alias("company"), F.col("source_key").alias("source"),
                    "r.cached_at", "r.payload", "r.seq")


def age_seconds(cached_at, as_of: str):
    return (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col(cached_at).cast("timestamp"))) / 1e6


def snapshot_fresh(latest: DataFrame, as_of: str, ttl_seconds: int = lx.SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Fresh iff age <= ttl (expired only when strictly older)."""
    return latest.where(age_seconds("cached_at", as_of) <= ttl_seconds)


def snapshot_age(latest: DataFrame, as_of: str) -> DataFrame:
    """'Hh Mm ago' or 'Mm ago' (floor division of the age in seconds)."""
    a = age_seconds("cached_at", as_of)
    h = F.floor(a / 3600).cast("long")
    m = F.floor((a - F.floor(a / 3600) * 3600) / 60).cast("long")
    txt = F.when(h > 0, F.format_string("%dh %dm ago", h, m)).otherwise(F.format_string("%dm ago", m))
    return latest.withColumn("age_text", txt)


def snapshot_append(batch: DataFrame, path: str) -> None:
    """Append non-empty snapshots (empty payload lists are not cached)."""
    ok = batch.where(F.coalesce(F.col("payload"), F.lit("")).isin("", "[]") == F.lit(False))
    ok.write.mode("append").partitionBy("source").parquet(path)


def snapshot_upsert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Append semantics with latest-wins reads: the union of the stored rows
    and a new batch (empty payloads skipped), reduced to the newest per key."""
    b = batch.where(~F.coalesce(F.col("payload"), F.lit("")).isin("", "[]"))
    return snapshot_latest(existing.unionByName(b))


def snapshot_clear(snapshots: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Delete the snapshots of the given companies (case-insensitive); with
    no company list everything is cleared."""
    if companies is None:
        return snapshots.limit(0)
    from renown.plans.strategy import broadcast_if_small

    c = broadcast_if_small(companies.select(F.lower("company").alias("_ck")).distinct())
    return snapshots.join(c, F.lower(snapshots["company"]) == c["_ck"], "left_anti")


def fetch_plan(grid: DataFrame, fresh: DataFrame) -> DataFrame:
    """Company x source grid split into cached (fresh snapshot exists) and
    fetch (it does not)."""
    f = fresh.select(F.col("company").alias("_c"), F.col("source").alias("_s")).withColumn("_hit", F.lit(True))
    j = grid.join(f, (F.lower(grid["company"]) == f["_c"]) & (F.lower(grid["source"]) == f["_s"]), "left")
    return j.select(grid["company"], grid["source"],
                    F.when(F.col("_hit"), F.lit("cached")).otherwise(F.lit("fetch")).alias("action"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Tokens and calls per (provider, model) plus an overall row; the overall
    sum is COALESCE(SUM, 0)."""
    per = usage.groupBy("provider", "model").agg(
        F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum("calls_made"), F.lit(0)).cast("long").alias("calls"))
    tot = usage.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("long").alias("tokens"),
                    F.coalesce(F.sum("calls_made"), F.lit(0)).cast("long").alias("calls")).select(
        F.lit("*").alias("provider"), F.lit("*").alias("model"), "tokens", "calls")
    return per.unionByName(tot)


def cached_reports(report_snapshots: DataFrame, as_of: str, schema: str,
                   ttl_seconds: int = lx.SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Cached-report read path: newest report snapshot per lower(company),
    kept only while fresh, JSON text parsed back into the report struct.
    report_snapshots: (company, source, cached_at, payload, seq) with the
    report JSON as payload (source = model used)."""
    k = report_snapshots.withColumn("company_key", F.lower("company"))
    g = k.groupBy("company_key").agg(
        F.max_by(F.struct("cached_at", "payload", "seq", "source"), F.struct("cached_at", "seq")).alias("r"))
    latest = g.select(F.col("company_key").alias("company"), "r.cached_at", "r.payload", F.col("r.source").alias("model_used"))
    fresh = latest.where(age_seconds("cached_at", as_of) <= ttl_seconds)
    return fresh.select("company", "cached_at", "model_used", F.from_json("payload", schema).alias("report"))


def usage_append(usage: DataFrame, path: str) -> None:
    """Append one ledger row per run (company lower-cased as stored)."""
    usage.withColumn("company", F.lower("company")).write.mode("append").parquet(path)
