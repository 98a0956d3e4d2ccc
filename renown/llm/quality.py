"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a fixed row of statistics (sizes, byte-class shares,
word lengths, repetition of words, shingles and lines, case and punctuation).
Trees are grown on the driver on about ``TRAIN_ROWS`` labelled rows (a
documented bound, chosen by hash), flattened into arrays and traversed for
whole batches with numpy in the scoring tasks.

Cases: null and empty texts get the statistics of an empty text and so a
score; without labelled rows every score is 0.5; labels that are null or not
0/1 are ignored, repeated labels count each; equal texts get equal scores;
long texts cost time linear in length (n log n for repeated words); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.llm.common import keep_share
from renown.llm.hashing import shingle_hashes, text_slices, word_hashes
from renown.llm.linear import boosted_scores, train_boosted

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
_GROUPS = [range(97, 123), range(65, 91), range(48, 58), (32,), (9, 10, 11, 12, 13), range(128, 256), (33,), (35,), (36,), (37,), (38,), (42,),
           (46,), (44,), (58, 59), (63,), (124,), (34, 39), (40, 41, 91, 93), (47, 92), (60, 62), (61, 95, 43, 45), (64,), (123, 125)]
_CLASS = np.zeros((256, len(_GROUPS)), np.float64)
for _j, _g in enumerate(_GROUPS):
    _CLASS[list(_g), _j] = 1


def _share(u: np.ndarray) -> tuple[float, float]:
    """Distinct share and share of the most common entry."""
    if not len(u):
        return 0.0, 0.0
    c = np.unique(u, return_counts=True)[1]
    return len(c) / len(u), c.max() / len(u)


def statistics(col: pa.Array):
    """(first row, matrix of statistics) for slices of a text column."""
    for lo, hi, b, off in text_slices(col):
        words, first = word_hashes(b, off)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        out = np.zeros((hi - lo, 10 + len(_GROUPS)))
        for r in range(hi - lo):
            own, w = b[off[r]:off[r + 1]], words[first[r]:first[r + 1]]
            n = len(own)
            if not n:
                continue
            hist = np.bincount(own, minlength=256)
            p = hist[hist > 0] / n
            ends = np.flatnonzero(own == 10)
            line = np.diff(np.concatenate([[-1], ends, [n]])) - 1
            lines = own.tobytes().split(b"\n")
            gaps = max(1, int(n - space[off[r]:off[r + 1]].sum()))
            out[r, :10] = (np.log1p(n), np.log1p(len(w)), gaps / max(1, len(w)), *_share(w), _share(shingle_hashes(w, 3))[0],
                           len(set(lines)) / len(lines), line.mean(), -(p * np.log(p)).sum(), line.max() / n)
            out[r, 10:] = hist @ _CLASS / n
        yield lo, out


def _scored(docs: DataFrame, keep: list[str], schema: str, finish) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, x in statistics(batch.column("text")):
                part = batch.slice(lo, len(x))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), finish(x)], [*keep, "out"])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, held_out=None, rows: int = TRAIN_ROWS):
    """Flattened trees from labels (doc_id, quality) of rows not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if held_out is not None:
        known = known.filter(~held_out)
    n = known.count()
    known = known.filter(keep_share(F.col("doc_id").cast("string"), n, rows))
    # about ``rows`` rows of two numbers
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    got = _scored(mine, ["label"], "label int, out array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64()))).toPandas()
    if not len(got):
        return None
    x, y = np.stack(got["out"].to_list()), got["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of rows
    return train_boosted(x[order], y[order])


def score(docs: DataFrame, model) -> DataFrame:
    """Per input row: doc_id, score (chance of label 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def finish(x):
        return pa.array(np.full(len(x), 0.5) if sent.value is None else boosted_scores(sent.value, x))

    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "doc_id long, out double", finish).withColumnRenamed("out", "score")
