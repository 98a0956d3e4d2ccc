"""N-gram Jaccard join: grouped prefix join with exact verification.

A document's set holds its distinct k-word shingles (``hashing``); two
documents link when ``100 * |A & B| >= 80 * |A | B|``.

1. Global order: shingles by corpus frequency class, then by hash.  Frequent
   ones are found over all texts, counted per task and summed; any consistent
   order gives the same links, so this table (bounded, see
   ``MAX_FREQUENT``) only keeps very common shingles out of prefixes.
2. Every document gets its prefix: the first ``n - ceil(0.8 n) + 1`` shingles.
   Sets that link share a prefix shingle.  Documents with identical prefix and
   size collapse into one group; exact copies thereby into one class.
3. Groups meet in the buckets of their prefix shingles; groups expand to their
   classes (distinct sets) and pairs are verified on whole sets.  Pairs are
   not enumerated within a bucket: every bucket and size band has one pivot,
   and a class meets the pivot it shares most buckets with (``PIVOT_ROUNDS``
   rounds with other pivots); verified links merge to components.  Only pairs
   in *different* components are enumerated afterwards, by shared prefix
   shingles, and verified where sizes and the number of prefix shingles
   shared leave a link possible.  So no link between different
   components is missed, and a large group of near copies costs pairs in
   proportion to its members.

Cases: null or empty text and text without words have an empty set, link with
nothing and are their own component; rows that repeat a doc_id are one node
whose links are those of all its texts, and every input row is returned; a
null doc_id links with nothing and has a null component; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renown.llm.common import components, filter_position, in_filter, key_filter, marked_rows, names, quoted, row_keys, scratch, written
from renown.llm.hashing import mix, set_keys, shingle_hashes, text_slices, word_hashes

SHINGLE = 5
PERCENT = 80
MAX_FREQUENT = 400_000  # entries of the frequency table sent to tasks (6.4 MB)
FREQUENT_FROM = 8
PIVOT_ROUNDS = 1
COUNT_SLICE = 4_000_000  # shingles counted together in a task
def _sets(batch, k):
    """Yields (row, sorted distinct shingle hashes) of a batch."""
    for lo, hi, b, off in text_slices(batch.column("text")):
        words, first = word_hashes(b, off)
        for r in range(hi - lo):
            yield lo + r, np.unique(shingle_hashes(words[first[r]:first[r + 1]], k))


def _count_frequent(k):
    def run(batches):
        held, size = [], 0

        def emit():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            more = c > 1
            return pa.RecordBatch.from_arrays([pa.array(h[more].view(np.int64)), pa.array(c[more].astype(np.int64))], ["h", "c"])

        for batch in batches:
            for _, u in _sets(batch, k):
                held.append(u)
                size += len(u)
                if size >= COUNT_SLICE:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()
    return run


def frequent_shingles(docs: DataFrame, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, sorted by hash."""
    counts = written(docs.select("text").mapInArrow(_count_frequent(k), "h long, c long")
                         .groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT_FROM))
    # the lowest count that keeps the table in its bound, from a histogram by powers of 2 ** (1/4)
    steps = counts.groupBy(F.floor(F.log2("c") * 4).alias("s")).count().orderBy(F.desc("s")).collect()
    total, low = 0, None
    for r in steps:
        total += r["count"]
        if total > MAX_FREQUENT:
            break
        low = r["s"]
    if low is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.filter(F.floor(F.log2("c") * 4) >= low).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy(np.int64)[order]


def _prefix(u: np.ndarray, known: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a sorted set, rarest frequency class first."""
    size = len(u) - (percent * len(u) + 99) // 100 + 1
    if len(known):
        at = np.minimum(np.searchsorted(known, u), len(known) - 1)
        f = np.where(known[at] == u, count[at], 0)
        if f.any():
            return u[np.lexsort((u, f))][:size]
    return u[:size]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_rows(docs: DataFrame, shared, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: set size, two set keys and prefix key."""
    def run(batches):
        known, count = shared.value
        for batch in batches:
            n, k1, k2, pk = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            for r, u in _sets(batch, k):
                n[r] = len(u)
                k1[r], k2[r] = set_keys(u)
                if len(u):
                    pk[r] = mix(_prefix(u, known, count, percent)).sum(dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n, k1, k2, pk))], ["doc_id", "n", "k1", "k2", "pk"])

    return _plain(docs).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, pk long")


def prefix_tokens(docs: DataFrame, leaders: DataFrame, n_leaders: int, shared, k: int, percent: int) -> DataFrame:
    """(token, node, at) of the prefixes of the group leaders, at = size * 2**32
    + position.  Texts that the bounded key filter lets through by chance only
    add a copy of their group to its buckets."""
    bitmap, bits = key_filter(leaders, "doc_id", n_leaders)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        known, count = shared.value
        for batch in batches:
            part = batch.filter(pa.array(in_filter(sent.value, batch.column("pos").to_numpy())))
            ids = part.column("doc_id").to_numpy()
            held, rows = [], 0
            for r, u in _sets(part, k):
                if len(u):
                    p = _prefix(u, known, count, percent)
                    held.append((p.view(np.int64), np.full(len(p), ids[r]), (len(u) << 32) + np.arange(len(p))))
                    rows += len(p)
                if rows > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["token", "node", "at"])
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["token", "node", "at"])

    d = _plain(docs).filter("doc_id is not null").withColumn("pos", filter_position(F.col("doc_id"), bits))
    return d.mapInArrow(run, "token long, node long, at long")


def texts_of(docs: DataFrame, ids: DataFrame, id_name: str, text_name: str) -> DataFrame:
    """Texts of the documents in ``ids`` and of a few others: unneeded texts
    are skipped at the scan by a bounded key filter, not shuffled."""
    bitmap, bits = key_filter(ids, id_name, ids.count())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            yield batch.select([id_name, text_name]).filter(pa.array(in_filter(sent.value, batch.column("pos").to_numpy())))

    d = _plain(docs).filter("doc_id is not null").toDF(id_name, text_name)
    return d.withColumn("pos", filter_position(F.col(id_name), bits)).mapInArrow(run, f"{id_name} long, {text_name} string")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the threshold."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                keep = np.zeros(part.num_rows, bool)
                x = dict(_sets(pa.RecordBatch.from_arrays([part.column("ta")], ["text"]), k))
                for r, v in _sets(pa.RecordBatch.from_arrays([part.column("tb")], ["text"]), k):
                    same = len(np.intersect1d(x[r], v, assume_unique=True))
                    keep[r] = 100 * same >= percent * (len(x[r]) + len(v) - same)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    left = pairs.join(texts_of(docs, pairs.select("a").distinct(), "a", "ta"), "a")
    both = left.join(texts_of(docs, pairs.select("b").distinct(), "b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links)
    return rows.drop("label").join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "label", F.coalesce("component", "node")).drop("component")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every input row."""
    with scratch(docs.sparkSession) as keep:
        shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))
        rows = keep(written(set_rows(docs, shared, k, percent)))
        filled, key = rows.filter("n > 0 and doc_id is not null"), F.struct("k1", "k2")
        classes = keep(written(filled.groupBy("k1", "k2", "n", "pk").agg(F.min("doc_id").alias("node"))))
        groups = written(classes.groupBy("pk", "n").agg(F.min("node").alias("doc_id"), F.count(F.lit(1)).alias("classes")))
        tokens = prefix_tokens(docs, groups, groups.count(), shared, k, percent)
        met = tokens.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("met > 1")
        # groups of several classes expand: the group's first class leads, the others join its buckets
        members = written(classes.join(groups.filter("classes > 1").select("pk", "n", F.col("doc_id").alias("leader")), ["pk", "n"]).select("leader", "node"))
        buckets = written(met)
        if not members.isEmpty():
            buckets = written(buckets.join(members.withColumnRenamed("node", "member"), F.col("node") == F.col("leader"), "left")
                              .select("token", F.coalesce("member", "node").alias("node"), "at", "met"))
        # one doc_id with several texts is one node
        texts = filled.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi").select("doc_id")
        links = written(filled.join(texts, "doc_id", "left_semi").join(classes, ["k1", "k2", "n"])
                        .select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b"))
        size = F.shiftright("at", 32)
        band = F.floor(F.log(size) / F.log(F.lit(100.0 / percent)))
        # the first pivots are the classes that meet most others, e.g. the origin of a group of copies
        central = written(buckets.groupBy("node").agg((-F.sum("met")).alias("rank")))
        buckets = buckets.drop("met")
        state = buckets.withColumn("label", F.col("node")).join(central, "node")
        pairs = members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
        for salt in range(PIVOT_ROUNDS):
            keyed = state.withColumn("band", band)
            draw = F.struct((F.col("rank") if salt == 0 else F.xxhash64("node", F.lit(salt))).alias("h"), "node", "label", "at")
            pivots = keyed.groupBy("token", "band").agg(F.min(draw).alias("pivot"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
            near = (keyed.join(pivots.select("token", "band", "pivot"), ["token", "band"])
                    .filter((F.col("label") != F.col("pivot.label")) & _sizes_fit(size, F.shiftright("pivot.at", 32), percent))
                    .groupBy(F.col("node").alias("a"), F.col("pivot.node").alias("b")).agg(F.count(F.lit(1)).alias("shared")))
            near = near.groupBy("a").agg(F.max_by("b", F.struct("shared", F.xxhash64("b", F.lit(salt)))).alias("b"))
            pairs = written(pairs.union(near).distinct() if salt == 0 else near)
            links = written(links.union(verified(docs, pairs, k, percent)))
            comp = components(links).withColumnRenamed("id", "node")
            state = buckets.join(comp, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            members = members.select("leader", "node").join(comp, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        # every remaining pair across components, by shared prefix shingles
        mixed = state.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
        left = written(state.join(mixed, "token", "left_semi"))
        x, y = left.alias("x"), left.alias("y")
        n, m = F.shiftright("x.at", 32), F.shiftright("y.at", 32)
        i, j = F.col("x.at").bitwiseAND(2**32 - 1), F.col("y.at").bitwiseAND(2**32 - 1)
        need = F.ceil((n + m) * percent / (100.0 + percent) - 1e-9)
        # sets that share ``need`` shingles share 1 + extra of their first n - need + 1 + extra; the last, more
        # frequent places of the prefixes need not meet
        extra = F.greatest(F.floor((need - F.ceil(F.greatest(n, m) * percent / 100.0 - 1e-9)) / 4), F.lit(0))
        rest = (x.join(y, F.col("x.token") == F.col("y.token"))
                .filter((F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & _sizes_fit(n, m, percent)
                        & (i <= n - need + extra) & (j <= m - need + extra))
                .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), extra.alias("extra")))
        rest = rest.groupBy("a", "b", "extra").agg(F.count(F.lit(1)).alias("shared")).filter("shared > extra").select("a", "b")
        u, v = members.alias("u"), members.alias("v")
        inner = (u.join(v, F.col("u.leader") == F.col("v.leader")).filter("u.node < v.node and u.label <> v.label")
                 .select(F.col("u.node").alias("a"), F.col("v.node").alias("b")))
        rest = written(rest.union(inner).distinct())
        comp = keep(components(links.union(verified(docs, rest, k, percent))))
        named = (classes.join(comp.withColumnRenamed("id", "node"), "node", "left")
                 .select("k1", "k2", "n", F.coalesce("component", "node").alias("component")))
        out = rows.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
        alone = F.col("doc_id").isNull() | (F.col("n") == 0)
        return out.select("doc_id", F.col("n").alias("n_shingles"),
                          F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _sizes_fit(n, m, percent):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def one_per_component(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows: the smallest (doc_id, row key),
    null ids last.  Rows are linked by their texts alone, so rows without a
    unique id take part, and texts that only share an id are not dropped; of
    rows equal in doc_id and text one stays (the one whose other columns, maps
    left out, have the smallest hash).  Rows are told apart by two 64-bit keys;
    rows that share the first one only by chance are never dropped.

    Only rows to drop or to reduce to one, and a few others, are shuffled."""
    spark = docs.sparkSession
    k1, k2 = names(docs, "_row", 2)
    first, second = row_keys(docs)
    with scratch(spark) as keep:
        rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), first.alias("rk"), second.alias("rk2"))
                       .groupBy("doc_id", "rk", "rk2").agg(F.count(F.lit(1)).alias("times")))
        comp = jaccard_components(docs.select(first.alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("rk"), "component_id").distinct()
        placed = written(rows.join(comp, "rk").withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id", "rk", "rk2")))
        best = placed.groupBy("component_id").agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        chance = rows.groupBy("rk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rk")
        gone = placed.join(best, "component_id").filter("place <> best").join(chance, "rk", "left_anti")
        dropped = keep(written(gone.select(F.col("rk").alias(k1), F.col("rk2").alias(k2))))
        touched = keep(written(dropped.union(rows.filter("times > 1").select("rk", "rk2")).distinct()))
    columns = quoted(docs.columns)
    marked, others = marked_rows(docs.withColumn(k1, first).withColumn(k2, second), touched, k1, k2)
    plain = [c for c, f in zip(columns, docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # equal rows are summed up before they meet their decision, so a row repeated any number of times is no hot key
    single = marked.groupBy(k1, k2).agg(F.min_by(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), F.xxhash64(*plain)).alias("r"))
    stay = single.join(dropped, [k1, k2], "left_anti").select(*[F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
    return others.select(*columns).union(stay)
