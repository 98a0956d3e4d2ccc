"""Snapshot store and usage ledger: replays, compaction, half-written batches."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from renown.operators import store as ST

ROWS = [("Co", "web", "2024-01-29 00:00:00", "[1]", 1), ("co", "WEB", "2024-01-30 22:30:00", "[2]", 2),
        ("x", "web", "2024-01-28 23:59:59", "[3]", 3), ("x", "news", "2024-01-30 10:00:00", "[]", 4),
        ("x", "news", "2024-01-30 11:00:00", None, 5), (None, "web", "2024-01-30 12:00:00", "[6]", 6)]


def _batch(spark, rows):
    df = spark.createDataFrame(rows, "company string, source string, ts string, payload string, seq long")
    return df.withColumn("cached_at", F.to_timestamp("ts")).drop("ts")


def _read(spark, root, **kw):
    return sorted(((r["company"], r["source"], r["payload"]) for r in ST.read_store(spark, root, **kw).collect()), key=str)


def test_replay_compaction_and_one_company(spark, tmp_path):
    root = str(tmp_path)
    assert _read(spark, root) == [] and ST.compact(spark, root) == 0
    want = sorted([("co", "web", "[2]"), ("x", "web", "[3]"), (None, "web", "[6]")], key=str)
    for _ in range(2):
        ST.write_batch(_batch(spark, ROWS), root, "a")
    assert _read(spark, root) == want
    assert ST.compact(spark, root) == 1 and _read(spark, root) == want
    assert os.listdir(f"{root}/log") == []
    # an old batch that is replayed after the compaction changes nothing
    ST.write_batch(_batch(spark, ROWS), root, "a")
    ST.write_batch(_batch(spark, [("CO", "web", "2024-01-30 23:00:00", "[7]", 7)]), root, "b")
    assert ST.compact(spark, root) == 2 and os.listdir(f"{root}/base") == ["gen=2"]
    assert _read(spark, root, company="cO") == [("co", "web", "[7]")]
    fresh = {r["company"] for r in ST.fresh_store(spark, root, "2024-01-31 00:00:00").collect()}
    assert fresh == {"co", None}


def test_replaced_batch_leaves_no_old_bucket(spark, tmp_path):
    root = str(tmp_path)
    ST.write_batch(_batch(spark, ROWS), root, "a")
    ST.write_batch(_batch(spark, ROWS[2:3]), root, "a")
    assert _read(spark, root) == [("x", "web", "[3]")]


def test_crashes_are_resolved_by_the_next_run(spark, tmp_path):
    root = str(tmp_path)
    ST.write_batch(_batch(spark, ROWS[:1]), root, "a")
    shutil.copytree(f"{root}/log", f"{root}/saved")
    ST.compact(spark, root)
    # the compaction stopped before it removed the batch
    shutil.copytree(f"{root}/saved/batch_id=a", f"{root}/log/batch_id=a")
    # a batch and a generation that stopped half-way
    ST.write_batch(_batch(spark, ROWS[2:3]), root, "b")
    os.remove(f"{root}/log/batch_id=b/_SUCCESS")
    os.makedirs(f"{root}/base/gen=2/bucket=1")
    assert _read(spark, root) == [("co", "web", "[1]")]
    assert ST.compact(spark, root) == 2 and _read(spark, root) == [("co", "web", "[1]")]
    ST.write_batch(_batch(spark, ROWS[2:3]), root, "b")
    assert _read(spark, root) == [("co", "web", "[1]"), ("x", "web", "[3]")]


@pytest.mark.parametrize("replays", [1, 3])
def test_usage_replays(spark, tmp_path, replays):
    root = str(tmp_path)
    cols = "run_id string, company string, provider string, model string, tokens_used long, calls_made long"
    one = spark.createDataFrame([("r1", "Co", "p", "m", 10, 1), ("r1", "Co", "q", "m", 5, 1), ("r2", "x", "p", "m", None, 1)], cols)
    two = spark.createDataFrame([("r3", "Co", "p", "m", 7, 2)], cols)
    for _ in range(replays):
        ST.record_usage(one, root)
    ST.record_usage(two, root)
    got = {(r["provider"], r["model"]): (r["tokens"], r["calls"]) for r in ST.recorded_totals(spark, root).collect()}
    assert got == {("p", "m"): (17, 4), ("q", "m"): (5, 1), ("*", "*"): (22, 5)}
    # a run that is recorded anew with less replaces what it wrote
    ST.record_usage(one.where("provider = 'p' and run_id = 'r1'"), root)
    got = {(r["provider"], r["model"]): r["tokens"] for r in ST.recorded_totals(spark, root).collect()}
    assert got == {("p", "m"): 17, ("*", "*"): 17}
