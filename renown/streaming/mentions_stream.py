"""Structured Streaming form of the mention flow (optional extension).

Landed mentions arrive as files; the stream removes exact duplicates inside
the snapshot lifetime (watermark = 48 h, the TTL), counts sentiment per
company in event-time windows, and appends snapshots per micro-batch.  The
batch operators are reused unchanged through ``DataFrame.transform``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import fingerprint

TTL = f"{lx.SNAPSHOT_TTL_SECONDS // 3600} hours"


def read_landed(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def dedup_within_ttl(stream: DataFrame, ts_col: str = "event_ts", delay: str = TTL) -> DataFrame:
    """Exact-duplicate removal (company, fingerprint) whose state is dropped
    once the watermark passes: duplicates are removed within the TTL.  In a
    stream the first arrival wins (the batch form keeps the smallest seq)."""
    return (stream.withColumn("fp", fingerprint("raw_text"))
            .withWatermark(ts_col, delay)
            .dropDuplicatesWithinWatermark(["company", "fp"]))


def windowed_sentiment(stream: DataFrame, ts_col: str = "event_ts", size: str = "1 day", delay: str = TTL) -> DataFrame:
    """Tumbling-window sentiment counts per company; late rows within the
    watermark update their window, later ones are dropped by the engine."""
    w = stream.withWatermark(ts_col, delay).groupBy(F.window(ts_col, size).alias("w"), "company")
    return w.agg(F.count(F.lit(1)).alias("result_count"),
                 *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")]) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def append_snapshots(path: str):
    """foreachBatch writer: the non-empty rows of each micro-batch go to the
    batch's own folder, partitioned by source; a replayed batch replaces it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ok = batch.where(~F.coalesce(F.col("payload"), F.lit("")).isin("", "[]"))
        ok.write.mode("overwrite").partitionBy("source").parquet(f"{path}/batch_id={batch_id}")
    return write


def start(query_df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append", once: bool = False):
    """Start a stream into parquet with a checkpoint folder (exactly-once file
    sink); ``once`` processes what is available and stops."""
    w = query_df.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).outputMode(mode)
    if once:
        w = w.trigger(availableNow=True)
    return w.start()
