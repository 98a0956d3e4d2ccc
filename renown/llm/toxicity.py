"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the presence of words (lower case, letter runs).  The labels are
only 0/1, so severity grades are made from them and the texts: grade 0 is
label 0; a row of label 1 gets 1, 2 or 3 by how many distinct marker words
(words that occur almost only under label 1 in the sample) it holds, cut at
the terciles of the sample.  Vocabulary, grades and the model (one weight per
word shared by all thresholds) come from about ``TRAIN_ROWS`` labelled rows,
a documented bound, chosen by hash; scoring reads every whole text.

The expected severity is the sum of P(grade >= k) over the thresholds k; a
document is called toxic when P(grade >= 1) is at least ``THRESHOLD``.

Cases: null and empty texts have no features and get the base severity;
without labelled rows of both kinds all severities are 0; labels that are
null or not 0/1 are ignored; equal texts get equal results; long texts cost
time linear in length; extra columns are ignored; an empty table gives an
empty result; a null doc_id is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.llm.common import keep_share, written
from renown.llm.hashing import text_slices, word_hashes
from renown.llm.linear import train_ordinal

TRAIN_ROWS = 20_000
VOCABULARY = 2048
MIN_DOCS = 8
MARKER_SHARE = 0.9
LEVELS = 4
THRESHOLD = 0.5
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _row_words(col: pa.Array):
    """(first row, rows, row index of each word, word hash) of text slices."""
    for lo, hi, b, off in text_slices(col):
        words, first = word_hashes(_LETTERS[b], off)
        yield lo, hi - lo, np.repeat(np.arange(hi - lo), np.diff(first)), words


def _found(row, words, vocabulary):
    """Distinct (row, feature) pairs of words in the sorted vocabulary."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    hit = vocabulary[at] == words
    both = np.unique(row[hit].astype(np.int64) * len(vocabulary) + at[hit])
    return both // len(vocabulary), both % len(vocabulary)


def _word_counts(batches):
    for batch in batches:
        label = batch.column("label").to_numpy()
        for lo, n, row, words in _row_words(batch.column("text")):
            if len(words):
                order = np.lexsort((words, row))
                row, words = row[order], words[order]
                new = np.append(True, (row[1:] != row[:-1]) | (words[1:] != words[:-1]))
                row, words = row[new], words[new]
            h, back = np.unique(words, return_inverse=True)
            bad = np.bincount(back, label[lo + row], len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(back, minlength=len(h)).astype(np.int64)), pa.array(bad)], ["h", "n", "bad"])


def _lower(docs: DataFrame, *keep):
    return docs.select(*keep, F.lower(F.col("text").cast("string")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, held_out=None, rows: int = TRAIN_ROWS):
    """(vocabulary, weights, thresholds) or None without both kinds of label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.filter(keep_share(F.col("doc_id").cast("string"), known.count(), rows))
    # about ``rows`` rows of two numbers
    sample = _lower(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), "label")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    n1, n0 = sizes[1], sizes[0]
    counts = sample.mapInArrow(_word_counts, "h long, n long, bad long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= MIN_DOCS)
    expected = F.col("n") * (n1 / (n0 + n1))
    spread = F.sqrt(F.col("n") * (n1 / (n0 + n1)) * (n0 / (n0 + n1)))
    top = counts.withColumn("z", F.abs(F.col("bad") - expected) / spread).orderBy(F.desc("z"), "h").limit(VOCABULARY).toPandas()
    if not len(top):
        return None
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    vocabulary = h[order]
    marker = (top["bad"] >= MARKER_SHARE * top["n"]).to_numpy()[order]

    def rows_of(batches):
        for batch in batches:
            for lo, n, row, words in _row_words(batch.column("text")):
                r, c = _found(row, words, vocabulary)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32)), pa.array(c))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, n), lists], ["label", "found"])

    got = written(sample.mapInArrow(rows_of, "label int, found array<long>")).toPandas()
    found = [np.asarray(v, np.int64) for v in got["found"]]
    row = np.repeat(np.arange(len(found)), [len(v) for v in found])
    col = np.concatenate(found) if len(row) else np.zeros(0, np.int64)
    marks = np.bincount(row, marker[col].astype(float), len(found)) if len(row) else np.zeros(len(found))
    bad = got["label"].to_numpy() == 1
    cuts = np.quantile(marks[bad], [1 / 3, 2 / 3])
    grade = np.where(bad, 1 + (marks > cuts[0]) + (marks > cuts[1]), 0).astype(np.int64)
    weights, thresholds = train_ordinal(row, col, grade, len(vocabulary), LEVELS)
    return vocabulary, weights, thresholds


def severity(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: doc_id, severity (expected grade, 0 to 3), p_toxic,
    grade (the likeliest) and toxic (0 or 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, n, row, words in _row_words(batch.column("text")):
                at_least = np.zeros((n, LEVELS - 1))
                if sent.value is not None:
                    vocabulary, weights, t = sent.value
                    r, c = _found(row, words, vocabulary)
                    score = np.bincount(r, weights[c], n)
                    at_least = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -35, 35)))
                each = -np.diff(np.hstack([np.ones((n, 1)), at_least, np.zeros((n, 1))]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array(at_least.sum(axis=1)), pa.array(at_least[:, 0].copy()),
                     pa.array(each.argmax(axis=1).astype(np.int32)), pa.array((at_least[:, 0] >= threshold).astype(np.int32))],
                    ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return _lower(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic int")
