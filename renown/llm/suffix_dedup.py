"""Repeated-substring removal by prefix doubling.

Every byte covered by a ``length``-byte string that also starts anywhere else
in the corpus (same document included) is removed; matches never cross
documents and are judged on the input texts.

Ranks are names: the name of the 2d bytes at a position is a 64-bit hash of
its names at the position and at offset d, so doubling (1, 2, 4, ... bytes) is
local to the task that holds the text, and only the question "which names are
unique" needs a shuffle.  Positions leave as soon as a name of theirs is
unique, in three steps at growing depth:

* 32 bytes, at anchors only.  The anchor of a window of ``length`` bytes is
  its 32-byte string with the smallest name (leftmost of equal ones), so equal
  windows have equal anchors at equal offsets; consecutive windows share one.
  About one position in 85 is an anchor.  Windows whose anchor name is unique
  are unique and leave.
* an anchor's whole context (all windows it owns, by their first and last
  window names): contexts that occur twice are repeated as a whole, without
  looking at single positions.
* ``length`` - 15 bytes, for contexts that are unique although their anchor is
  not (edges of repeated passages), one of each distinct context: cells of 16
  windows leave when the bytes all 16 share are unique, and cells that occur
  twice as a whole are repeated as a whole.
* full ``length``, only for the windows of the remaining cells.

What goes on from step to step is chosen by bounded key filters at the scan
(the texts are read again, not shuffled); these let a few others through,
which are unique names or further true occurrences and change no result.

Names replace sorted ranks and no step compares texts, so the result is exact
up to 64-bit collisions.  Spans return to their documents by an outer join;
texts of documents without any span are not shuffled.

Cases: null text is empty; texts shorter than ``length`` have no window and
keep everything; repeated rows (also of one doc_id) are separate occurrences
and each is returned; a null doc_id is kept as null; a text of any length is
handled in one task in memory proportional to that text; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renown.llm.common import filter_position, in_filter, key_filter, written
from renown.llm.hashing import BYTE_TABLE, mix, text_slices

LENGTH = 200
ANCHOR = 32
CELL = 16
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a, b):
    x = a * _M1 + b
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _power(depth: int) -> int:
    return 1 << (depth.bit_length() - 1)


def _doubled(b: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Names at the depths in use: entry i of depth d names the bytes
    [i, i + d).  Depths double; ``length`` itself is two overlapping halves."""
    keep = {ANCHOR, _power(length - CELL + 1), _power(length)}
    names, d, out = BYTE_TABLE[b], 1, {}
    while True:
        if d in keep:
            out[d] = names
        if 2 * d > length:
            break
        names = _pair(names[:-d], names[d:]) if len(names) > d else names[:0]
        d *= 2
    rest = length - d
    out[length] = _pair(names[:len(names) - rest], names[rest:]) if rest and len(names) > rest else names if not rest else names[:0]
    return out


def _core_names(names: dict[int, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length - CELL + 1`` bytes at the given positions."""
    depth = length - CELL + 1
    half = _power(depth)
    return _pair(names[half][at], names[half][at + depth - half])


def _leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest entry of every window of ``width``."""
    low, at, d = h, np.arange(len(h), dtype=np.int32), 1
    while d < width:
        step = min(d, width - d)
        left = low[:-step] <= low[step:]
        at = np.where(left, at[:-step], at[step:])
        low = np.where(left, low[:-step], low[step:])
        d += step
    return at


def _contexts(b, off, length):
    """Names by depth, and the anchors of one slice: (row, anchor name,
    context name, first window, number of windows, anchor); the first window
    is relative to its row, the anchor to the slice."""
    none = {}, *(np.zeros(0, np.int64),) * 6
    if len(b) < length:
        return none
    names = _doubled(b, length)
    width = length - ANCHOR + 1
    at = _leftmost_min(names[ANCHOR], width)[:len(b) - length + 1]
    start = np.arange(len(at))
    row = np.searchsorted(off, start, "right") - 1
    valid = start + length <= off[row + 1]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (at[1:] == at[:-1]) & (row[1:] == row[:-1]))
    lo = np.flatnonzero(new)
    if not len(lo):
        return none
    # a run ends before the next run begins or at the row's last window
    hi = np.minimum(np.append(lo[1:], len(at)) - 1, off[row[lo] + 1] - length)
    a = at[lo]
    whole = names[length]
    shape = ((a - lo) * 512 + (hi - lo)).astype(np.uint64)
    ctx = mix(_pair(whole[lo], whole[hi]) + shape * _M1)
    return names, row[lo], names[ANCHOR][a], ctx, lo - off[row[lo]], hi - lo + 1, a


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))


def _anchor_names(length):
    """Anchor names of the windows, each with its count in the slice."""
    def run(batches):
        for batch in batches:
            for _, _, b, off in text_slices(batch.column("text")):
                h, c = np.unique(_contexts(b, off, length)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["anchor", "c"])
    return run


def name_position(name, bits: int):
    """Filter position of a name, the same as ``name % bits`` in numpy."""
    return F.pmod(name, F.lit(bits))


def _place(rk: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Name of one occurrence of a context."""
    return mix(_pair(rk.view(np.uint64), at.astype(np.uint64))).view(np.int64)


def _anchor_rows(length, shared, bits):
    """Anchors whose name is in the filter, with their contexts."""
    def run(batches):
        for batch in batches:
            rk = batch.column("rk").to_numpy()
            for lo, _, b, off in text_slices(batch.column("text")):
                _, row, kg, ctx, first, n, _ = _contexts(b, off, length)
                kg = kg.view(np.int64)
                some = in_filter(shared.value, kg % bits)
                own, at = rk[lo + row[some]], (first * 512 + n)[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kg[some]), pa.array(ctx.view(np.int64)[some]), pa.array(own), pa.array(at), pa.array(_place(own, at))],
                    ["anchor", "ctx", "rk", "at", "place"])
    return run


def _cells(b, off, rk, length, chosen, bits):
    """Names by depth and the cells of the chosen contexts of one slice: (row,
    core name, first window, number of windows).  A cell holds the windows
    whose distance to the anchor has the same quotient by CELL, so equal
    windows lie in cells of equal core: the bytes common to the whole cell."""
    names, row, _, _, first, n, anchor = _contexts(b, off, length)
    some = in_filter(chosen, _place(rk[row], first * 512 + n) % bits) if len(n) else np.zeros(0, bool)
    row, first, n, anchor = row[some], first[some], n[some], anchor[some]
    if not len(n):
        return (names, *(np.zeros(0, np.int64),) * 4)
    which = np.repeat(np.arange(len(n)), n)
    start = first[which] + np.arange(len(which)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
    cell = (anchor[which] - off[row[which]] - start) // CELL
    new = np.append(True, (which[1:] != which[:-1]) | (cell[1:] != cell[:-1]))
    lo = np.flatnonzero(new)
    core = _core_names(names, anchor[which[lo]] - cell[lo] * CELL, length)
    return names, row[which[lo]], core, start[lo], np.diff(np.append(lo, len(which)))


def _cell_rows(length, contexts, rows, bits):
    """Cells of the contexts in the filter, of texts in the filter ``rows``."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(rows.value[0], batch.column("rk").to_numpy() % rows.value[1])))
            rk = batch.column("rk").to_numpy()
            for lo, hi, b, off in text_slices(batch.column("text")):
                names, row, core, first, n = _cells(b, off, rk[lo:hi], length, contexts.value, bits)
                if len(n):
                    own, at, whole = rk[lo + row], first * 512 + n, names[length]
                    name = mix(_pair(whole[off[row] + first], whole[off[row] + first + n - 1]) + n.astype(np.uint64) * _M1)
                    yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(name.view(np.int64)), pa.array(own), pa.array(at), pa.array(_place(own, at))],
                                                     ["core", "cell", "rk", "at", "place"])
    return run


def _window_rows(length, contexts, cells, rows, bits, cell_bits):
    """Names of all windows of the cells in the filter ``cells``."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(rows.value[0], batch.column("rk").to_numpy() % rows.value[1])))
            rk = batch.column("rk").to_numpy()
            for lo, hi, b, off in text_slices(batch.column("text")):
                names, row, _, first, n = _cells(b, off, rk[lo:hi], length, contexts.value, bits)
                some = in_filter(cells.value, _place(rk[lo + row], first * 512 + n) % cell_bits) if len(n) else np.zeros(0, bool)
                row, first, n = row[some], first[some], n[some]
                if not len(n):
                    continue
                starts = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
                row = np.repeat(row, n)
                yield pa.RecordBatch.from_arrays([pa.array(names[length][off[row] + starts].view(np.int64)), pa.array(rk[lo + row]), pa.array(starts)],
                                                 ["name", "rk", "start"])
    return run


def _kinds(found: DataFrame, outer: str, inner: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (outer, inner, rk, at, place): the rows whose inner name is
    repeated, and one place of every inner name whose outer name has others too."""
    names = written(found.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("c"), F.max("place").alias("place"), F.max_by("rk", "place").alias("rk")))
    whole = found.join(names.filter("c > 1").select(outer, inner), [outer, inner], "left_semi").select("rk", "at")
    several = names.groupBy(outer).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(outer)
    return whole, written(names.join(several, outer, "left_semi").select("place", "rk"))


def removed_mask(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by the windows ``first * 512 + count``."""
    change = np.zeros(n + 1, np.int64)
    first, count = at // 512, at % 512
    np.add.at(change, first, 1)
    np.add.at(change, first + count - 1 + length, -1)
    return np.cumsum(change[:-1]) > 0


def _cut_rows(length, with_text):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("ats")
            for lo, hi, b, off in text_slices(batch.column("text")):
                out = [[] for _ in names[1:]]
                for r in range(lo, hi):
                    own = b[off[r - lo]:off[r - lo + 1]]
                    at = spans[r].values
                    gone = removed_mask(len(own), at.to_numpy() if at is not None else np.zeros(0, np.int64), length)
                    kept = own[~gone].tobytes()
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                    for c, v in zip(out, (len(own), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *map(pa.array, out)], names)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    with ``with_text``, the remaining bytes."""
    if not ANCHOR < length <= 512:
        raise ValueError(f"length must be over {ANCHOR} and at most 512")
    keyed, sc = _keyed(docs), docs.sparkSession.sparkContext
    # depth 32, anchors only: names that occur more than once
    names = keyed.select("text").mapInArrow(_anchor_names(length), "anchor long, c long")
    names = written(names.groupBy("anchor").agg(F.sum("c").alias("c")).filter("c > 1").select("anchor"))
    bitmap, bits = key_filter(names, "anchor", names.count(), name_position)
    # contexts of those anchors (others that the filter lets through are unique, and so are their windows)
    anchors = written(keyed.select("rk", "text").mapInArrow(_anchor_rows(length, sc.broadcast(bitmap), bits), "anchor long, ctx long, rk long, at long, place long"))
    whole, open_contexts = _kinds(anchors, "anchor", "ctx")
    # cells of contexts whose anchor has other contexts too, one occurrence of each context; places
    # that a filter lets through by chance are real ones, so they only add true occurrences
    chosen, bits = key_filter(open_contexts, "place", open_contexts.count(), name_position)
    chosen, rows = sc.broadcast(chosen), sc.broadcast(key_filter(open_contexts, "rk", open_contexts.count(), name_position))
    cells = written(keyed.select("rk", "text").mapInArrow(_cell_rows(length, chosen, rows, bits), "core long, cell long, rk long, at long, place long"))
    more, open_cells = _kinds(cells, "core", "cell")
    picked, cell_bits = key_filter(open_cells, "place", open_cells.count(), name_position)
    rows = sc.broadcast(key_filter(open_cells, "rk", open_cells.count(), name_position))
    windows = keyed.select("rk", "text").mapInArrow(_window_rows(length, chosen, sc.broadcast(picked), rows, bits, cell_bits), "name long, rk long, start long")
    twice = (windows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("c > 1")
             .select("rk", (F.col("start") * 512 + 1).alias("at")))
    spans = written(whole.union(more).union(twice).groupBy("rk").agg(F.collect_set("at").alias("ats")))
    bitmap, bits = key_filter(spans, "rk", spans.count())
    pos = filter_position(F.col("rk"), bits)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def untouched(batches):
        cut = _cut_rows(length, with_text)
        for batch in batches:
            rest = batch.filter(pa.array(~in_filter(sent.value, batch.column("pos").to_numpy())))
            empty = pa.nulls(len(rest), pa.list_(pa.int64()))
            yield from cut([pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("text"), empty], ["doc_id", "text", "ats"])])

    clean = keyed.withColumn("pos", pos).select("doc_id", "text", "pos").mapInArrow(untouched, schema)
    touched = (_kept_by(keyed, bitmap, bits, "doc_id long, text string, rk long").join(spans, "rk", "left")
               .select("doc_id", "text", "ats").mapInArrow(_cut_rows(length, with_text), schema))
    return clean.union(touched)


def _kept_by(keyed: DataFrame, bitmap: np.ndarray, bits: int, schema: str) -> DataFrame:
    """Rows whose ``rk`` is in the key filter (with a few others)."""
    sent, names = keyed.sparkSession.sparkContext.broadcast(bitmap), keyed.columns

    def run(batches):
        for batch in batches:
            keep = pa.array(in_filter(sent.value, batch.column("pos").to_numpy()))
            yield batch.select(names).filter(keep)

    return keyed.withColumn("pos", filter_position(F.col("rk"), bits)).select(*keyed.columns, "pos").mapInArrow(run, schema)
