"""Embedding near-duplicates: exact metric range join on the unit sphere.

Vectors are scaled to length 1 in double precision; cosine >= c means a
Euclidean distance of at most r = sqrt(2 - 2c).  Identical vectors collapse to
one class with a count.  Pivots (far apart, from a bounded sample) partition
the classes by nearest pivot.  By the triangle inequality a vector x can have
a partner with home cell j only if d(x, p_j) <= d(x, p_home) + 2r and
d(x, p_j) <= radius_j + r.  A pair of two cells is compared in one of them,
the lower if their numbers differ by an even number, else the higher; x is
replicated to those cells of the condition where its pairs are compared.  So
every pair meets exactly once across cells (in both directions within one),
and link counts need no de-duplication: a block counts its home rows' links
and those of the replicas.  Cells join independently and, when large, in
blocks of at most ``BLOCK`` home rows by as many members (fewer if vectors are
long); a block is a matrix product that returns link counts and a spanning
forest of its links, never the pairs, so a hot cell or a large group of near
copies is split and nothing grows with the square of a group in the output.

A row is sent once for each block that holds it.  Where pivots exclude little,
many cells only add replicas: cells are first counted (no vector is sent), and
those as large as a block are taken unless that means many more comparisons.
Evenly spread vectors so take n * n / BLOCK sent rows, of which none is kept
in a table, and n * n / 2 comparisons; a task holds one block at a time, and
hands replicas on in small frames.

Cases: null, zero or empty vectors and vectors with null or non-finite
components link with nothing and are their own component; vectors of
different length never link; rows that repeat a vec_id count as separate
vectors and share a component; a null vec_id gets its links but no component
(null); extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.llm.common import components, keep_share, written

COSINE = 0.95
PIVOT_SAMPLE = 4000  # vectors among which pivots are chosen
CELL_ROWS = 4096
MAX_PIVOTS = 512
BLOCK = 1 << 14  # rows of one side of a block at most
BLOCK_BYTES = 1 << 24  # bytes of one side in double precision at most
ENTRIES = 1 << 20  # numbers of one array that a task makes of the rows it reads
STRIP = 1 << 21  # products of a block that are computed at once
MORE_COMPARED = 1.5  # fewer, larger cells are taken up to so many times the comparisons
MAX_TASKS = 1 << 13


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def far_apart(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of the sample by farthest-first traversal."""
    chosen, near = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(k, len(sample)):
        near = np.minimum(near, np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[chosen[-1]])))
        chosen.append(int(near.argmax()))
    return sample[chosen]


def matrix(vectors: pd.Series, size: int) -> np.ndarray:
    return unit(np.concatenate(vectors.to_numpy()).reshape(-1, size).astype(np.float64))


def block_rows(size: int) -> int:
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * size)))


def _distances(frames, pivots: dict):
    """(length, rows, distances to the pivots, home cell, distance to it), few rows at a time."""
    for f in frames:
        for size, part in f.groupby("size"):
            p = pivots[size]
            step = max(1, ENTRIES // max(size, len(p)))
            for lo in range(0, len(part), step):
                some = part.iloc[lo:lo + step]
                d = np.sqrt(np.maximum(0, 2 - 2 * matrix(some["vector"], size) @ p.T))
                home = d.argmin(axis=1)
                yield size, some, d, home, d[np.arange(len(d)), home]


def _radii(pivots: dict):
    """Home cells with the distance of their farthest row."""
    def run(frames):
        for size, _, _, home, near in _distances(frames, pivots):
            yield pd.DataFrame({"size": size, "cell": home, "near": near}).groupby(["size", "cell"], as_index=False).max()
    return run


def _goes(d, home, near, reach, r):
    """Which cells each row is sent to."""
    go = (d <= near[:, None] + 2 * r + 1e-9) & (d <= reach + r + 1e-9)
    cells = np.arange(d.shape[1], dtype=np.int16)
    apart = cells - home[:, None].astype(np.int16)
    go &= (apart < 0) == (apart % 2 == 0)  # where pairs of these two cells are compared
    go[np.arange(len(d)), home] = True
    return go


def _reach(radius: dict, size: int, n: int) -> np.ndarray:
    return np.array([radius.get((size, j), -np.inf) for j in range(n)])


def _counted(pivots: dict, r: float, radius: dict):
    """Rows at home in each cell and rows sent there."""
    def run(frames):
        for size, _, d, home, near in _distances(frames, pivots):
            n = d.shape[1]
            go = _goes(d, home, near, _reach(radius, size, n), r)
            yield pd.DataFrame({"size": size, "cell": np.arange(n), "own": np.bincount(home, minlength=n), "members": go.sum(axis=0)})
    return run


def _sent(pivots: dict, r: float, radius: dict):
    """Each row beside the cells it is sent to."""
    def run(frames):
        for size, part, d, home, near in _distances(frames, pivots):
            at, cell = np.nonzero(_goes(d, home, near, _reach(radius, size, d.shape[1]), r))
            node, copies, vector = (part[c].to_numpy() for c in ("node", "copies", "vector"))
            step = max(1, ENTRIES // size)
            for lo in range(0, len(at), step):
                some, to = at[lo:lo + step], cell[lo:lo + step]
                yield pd.DataFrame({"size": size, "cell": to, "home": to == home[some], "node": node[some], "copies": copies[some], "vector": vector[some]})
    return run


def _cells(slim: DataFrame, pivots: dict, r: float) -> tuple[dict, dict]:
    """Of each (length, cell): the radius, and (rows at home, rows sent there)."""
    radius = {(h["size"], h["cell"]): h["radius"] for h in
              slim.mapInPandas(_radii(pivots), "size int, cell int, near double").groupBy("size", "cell").agg(F.max("near").alias("radius")).collect()}
    counted = slim.mapInPandas(_counted(pivots, r, radius), "size int, cell int, own long, members long")
    counted = counted.groupBy("size", "cell").agg(F.sum("own").alias("own"), F.sum("members").alias("members")).collect()
    return radius, {(c["size"], c["cell"]): (c["own"], c["members"]) for c in counted if c["members"]}


def _block(cosine: float):
    def run(key, f):
        home, other = f[f["home"]], f[~f["home"]]
        if not len(home) or not len(other):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        size = int(key[0])
        x, y = matrix(home["vector"], size), matrix(other["vector"], size)
        ids, copies, guest = other["node"].to_numpy(), other["copies"].to_numpy(), other["guest"].to_numpy()
        own, times = home["node"].to_numpy(), home["copies"].to_numpy()
        # nodes: members first, then home rows that are not among them
        where = {n: i for i, n in enumerate(ids)}
        place = np.array([where.setdefault(n, len(where)) for n in own])
        names = np.array(list(where), np.int64)
        label, counts, guests = np.arange(len(names)), np.zeros(len(own), np.int64), np.zeros(len(ids), np.int64)
        strip = max(1, STRIP // len(y))
        for lo in range(0, len(x), strip):
            near = x[lo:lo + strip] @ y.T >= cosine
            for i in np.flatnonzero(near.any(axis=1)):
                near[i] &= ids != own[lo + i]
                hit = np.flatnonzero(near[i])
                if not len(hit):
                    continue
                counts[lo + i] = copies[hit].sum()
                guests[hit] += times[lo + i]
                at = np.append(label[hit], label[place[lo + i]])
                low = at.min()
                if (at != low).any():
                    label[np.isin(label, at)] = low
        joined = np.flatnonzero(label != np.arange(len(names)))
        some, too = np.flatnonzero(counts), np.flatnonzero((guests > 0) & guest)
        nodes = np.append(own[some], ids[too])
        return pd.DataFrame({"a": np.append(nodes, names[joined]), "b": np.append(nodes, names[label[joined]]),
                             "links": np.concatenate([counts[some], guests[too], np.zeros(len(joined), np.int64)])})
    return run


def near_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per input row: vec_id, n_links, component_id, kept."""
    spark, r = vectors.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.coalesce((F.size("vector") > 0) & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    # 0.0 and -0.0 are one value; keys and one representative per distinct vector
    rows = rows.withColumn("valid", valid).withColumn("vector", F.when(F.col("valid"), F.transform("vector", lambda v: v + F.lit(0).cast("float"))))
    rows = rows.withColumn("node", F.xxhash64("vector"))
    classes = written(rows.filter("valid").groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("node").alias("node"), F.min("vec_id").alias("first"))
                          .withColumn("size", F.size("vector")))
    sizes = {x["size"]: x["n"] for x in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for size, n in sizes.items():
        some = classes.filter((F.col("size") == size) & keep_share(F.col("node"), n, PIVOT_SAMPLE)).select("vector").toPandas()["vector"].tolist()
        some = some or [classes.filter(F.col("size") == size).first()["vector"]]
        pivots[size] = far_apart(unit(np.array(some, np.float64)), min(MAX_PIVOTS, -(-n // CELL_ROWS)))
    slim = classes.select("size", "vector")
    radius, cells = _cells(slim, pivots, r)
    # the pivots are in order, so the first ones are a choice of their own
    fewer = {size: p[:-(-sizes[size] // block_rows(size))] for size, p in pivots.items()}
    fewer = {size: p for size, p in fewer.items() if len(p) < len(pivots[size])}
    if fewer:
        compared = lambda of, size: sum(own * members for (s, _), (own, members) in of.items() if s == size)
        wide, large = _cells(slim.filter(F.col("size").isin(*fewer)), fewer, r)
        for size in fewer:
            if compared(large, size) <= MORE_COMPARED * compared(cells, size):
                pivots[size] = fewer[size]
                radius = {k: v for k, v in radius.items() if k[0] != size} | {k: v for k, v in wide.items() if k[0] == size}
                cells = {k: v for k, v in cells.items() if k[0] != size} | {k: v for k, v in large.items() if k[0] == size}
    split = [(size, cell, -(-own // block_rows(size)) or 1, -(-members // block_rows(size))) for (size, cell), (own, members) in cells.items()]
    tasks = max(1, min(MAX_TASKS, sum(na * nb for *_, na, nb in split)))
    split = F.broadcast(spark.createDataFrame(split, "size int, cell int, na long, nb long"))  # at most MAX_PIVOTS rows a vector length
    placed = classes.select("size", "node", "copies", "vector").mapInPandas(
        _sent(pivots, r, radius), f"size int, cell int, home boolean, node long, copies long, vector {dict(classes.dtypes)['vector']}")
    placed = placed.join(split, ["size", "cell"], "left")
    part = F.xxhash64("node", F.lit(5))
    na, nb = (F.coalesce(F.col(c), F.lit(1).cast("long")) for c in ("na", "nb"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_home = F.transform(upto(nb), lambda b: F.struct(F.pmod(part, na).alias("a"), b.alias("b"), F.lit(True).alias("home"), F.lit(False).alias("guest")))
    as_member = F.transform(upto(na), lambda a: F.struct(a.alias("a"), F.pmod(part, nb).alias("b"), F.lit(False).alias("home"), (~F.col("home")).alias("guest")))
    runs, keys = F.when(F.col("home"), F.concat(as_home, as_member)).otherwise(as_member), ["size", "cell", "a", "b"]
    both = placed.select("size", "cell", F.explode(runs).alias("r"), "node", "copies", "vector")
    both = both.select("size", "cell", "r.*", "node", "copies", "vector").repartition(tasks, *keys)
    found = written(both.groupBy(*keys).applyInPandas(_block(cosine), "a long, b long, links long"))
    counts = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    names = classes.select("node", "first", "copies")
    # one vec_id with several vectors is one node: its vectors' classes are linked
    twice = rows.filter("valid and vec_id is not null").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("vec_id")
    same = rows.filter("valid").join(twice, "vec_id", "left_semi").select(F.col("vec_id"), "node")
    same = same.groupBy("vec_id").agg(F.min("node").alias("a")).join(same, "vec_id").select("a", F.col("node").alias("b"))
    comp = components(found.filter("a <> b").select("a", "b").union(same))
    named = names.join(counts, "node", "left").join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("valid"), F.col("node")).alias("node")).join(named, "node", "left")
    cid = F.when(F.col("vec_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
