"""Language identification by hierarchical discrimination.

Texts are lower-cased, everything but letters is one space, and byte 2- to
4-grams are hashed into ``DIMS`` counts; features are the square roots of
their shares.  First the language family is predicted, then one-versus-one
linear SVMs separate the languages within it; families are told apart by
one-versus-one SVMs too.  Languages outside ``FAMILIES`` are families of
their own.  Models are trained on about ``TRAIN_ROWS`` labelled rows (a
documented bound, chosen by hash) on the driver; prediction reads every whole
text.

Cases: ``und`` with score 0 for null text, text without a letter, or when
nothing could be learned (no labelled rows); a single learned language gets
score 1; equal texts get equal results, ties go to the first language by
name; long texts cost time linear in length; extra columns are ignored; an
empty table gives an empty result; a null doc_id is kept and is not held out.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.llm.common import keep_share
from renown.llm.hashing import text_slices
from renown.llm.linear import train_svm

DIMS = 2048
SLICE_ROWS = 256  # rows whose features are held at once
TRAIN_ROWS = 4000
UNKNOWN = "und"
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
            "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic"}
LETTER = re.compile(r"[^\W\d_]")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True


def gram_features(col: pa.Array):
    """(first row, features) for slices of a column of lower-cased texts."""
    pieces = ((at + lo, b, off) for at in range(0, len(col), SLICE_ROWS) for lo, _, b, off in text_slices(col.slice(at, SLICE_ROWS)))
    for lo, b, off in pieces:
        rows = len(off) - 1
        letter = _IS_LETTER[b]
        # one space before every row's words and between words
        start = np.zeros(len(b), bool)
        start[off[:-1][off[:-1] < len(b)]] = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep |= start
        at = np.flatnonzero(keep)
        text = np.where(letter[at], b[at], 32).astype(np.uint64)
        row = np.searchsorted(off, at, "right") - 1
        x = np.zeros((rows, DIMS), np.float32)
        for n in (2, 3, 4):
            if len(text) < n:
                continue
            code = np.full(len(text) - n + 1, np.uint64(n))
            for j in range(n):
                code = code * np.uint64(257) + text[j:len(text) - n + 1 + j]
            h = ((code * _MULT) >> np.uint64(64 - 11)).astype(np.int64)
            same = row[n - 1:] == row[:len(row) - n + 1]
            x += np.bincount((row[:len(h)] * DIMS + h)[same], minlength=rows * DIMS).reshape(rows, DIMS)
        x /= np.maximum(1, x.sum(axis=1, keepdims=True))
        yield lo, np.sqrt(x)


def _features(docs: DataFrame, *keep: str) -> DataFrame:
    kept = docs.select(*keep, F.lower(F.col("text").cast("string")).alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes if n != "text") + ", x binary"

    def run(batches):
        for batch in batches:
            for lo, x in gram_features(batch.column("text")):
                part = batch.slice(lo, len(x))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([v.tobytes() for v in x], pa.binary())], [*keep, "x"])

    return kept.mapInArrow(run, schema)


def _one_versus_one(x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> tuple[list[str], list[tuple[int, int, np.ndarray]]]:
    names = sorted(set(y))
    return names, [(i, j, train_svm(x, rows[m], np.where(y[m] == a, 1.0, -1.0)))
                   for (i, a), (j, b) in combinations(list(enumerate(names)), 2) for m in [np.flatnonzero((y == a) | (y == b))]]


def train(docs: DataFrame, held_out=None, rows: int = TRAIN_ROWS, families: dict[str, str] = FAMILIES):
    """Models from the labelled rows that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        known = known.filter(~F.coalesce(held_out, F.lit(False)))
    n = known.select(F.lit(1)).count()
    sample = _features(known.filter(keep_share(F.col("doc_id").cast("string"), n, rows)).select(F.col("lang").cast("string").alias("lang"), "text"), "lang").toArrow()
    x = np.empty((sample.num_rows, DIMS), np.float32)
    for i, v in enumerate(sample.column("x")):
        x[i] = np.frombuffer(v.as_buffer(), np.float32)
    lang = np.array(sample.column("lang").to_pylist(), str)
    del sample
    some = np.flatnonzero(x.any(axis=1))
    if not len(some):
        return None
    lang = lang[some]
    family = np.array([families.get(v, f"={v}") for v in lang])
    return _one_versus_one(x, some, family), {
        f: _one_versus_one(x, some[family == f], lang[family == f]) for f in sorted(set(family))}


def _shares(x: np.ndarray, model) -> np.ndarray:
    """Per row and class the mean chance of winning its pairwise contests,
    from the SVM margins, normalised."""
    names, pairs = model
    p = np.zeros((len(x), len(names)))
    if len(names) == 1:
        return p + 1
    for i, j, w in pairs:
        win = 1 / (1 + np.exp(-np.clip(2 * (x @ w[:-1] + w[-1]), -35, 35)))
        p[:, i] += win
        p[:, j] += 1 - win
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model, *keep: str) -> DataFrame:
    """``keep`` columns, lang_pred and score of every input row."""
    plain = F.col("text").cast("string")
    kept = docs.select(*keep, F.lower(plain).alias("text"))
    schema = ", ".join([f"{n} {t}" for n, t in kept.dtypes if n != "text"] + ["lang_pred string", "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, x in gram_features(batch.column("text")):
                part = batch.slice(lo, len(x))
                names, score = [UNKNOWN] * len(x), np.zeros(len(x))
                if sent.value is not None:
                    families, inner = sent.value
                    x = x.astype(np.float64)
                    p = _shares(x, families)
                    best = p.argmax(axis=1)
                    for f in np.unique(best):
                        at = np.flatnonzero(best == f)
                        own = inner[families[0][f]]
                        q = _shares(x[at], own)
                        pick = q.argmax(axis=1)
                        score[at] = p[at, f] * q[np.arange(len(at)), pick]
                        for i, k in zip(at, pick, strict=True):
                            names[i] = own[0][k]
                for i, t in enumerate(part.column("text")):
                    s = t.as_py()
                    if s is None or not LETTER.search(s):
                        names[i], score[i] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))],
                                                 [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def identified(docs: DataFrame, min_score: float, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose language is known with at least ``min_score``."""
    model, columns = train(docs, rows=train_rows), docs.columns
    wide = docs.withColumns({f"_{i}": F.col(f"`{c}`") for i, c in enumerate(columns)})
    kept = predict(wide, model, *[f"_{i}" for i in range(len(columns))]).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
