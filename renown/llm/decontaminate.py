"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Texts become words (lower case, runs of letters and digits).  A mask reads
the words of a window at its 1-positions and ignores the others, so a seed
hash survives substitutions at ignored places.  Seeds of all windows of all
texts join the seeds of the benchmark; every hit fixes a document, an item
and a diagonal.  Around hits the item is laid over the document along the
diagonal and compared word by word: the pair is a leak when some window of
``window`` item words (the whole item when it is shorter) has at least
``percent`` % equal words.

The masks alone lay not every pair that passes this rule (4 substitutions in
20 words can hit all of their windows), so seeds of one short mask are made
too; each mask's windows run to the end of the text.  With the given window
and percentage the masks meet every pattern of substitutions in items of
``span`` words and more (enumerated in the tests); with others a run of equal
words that every such overlap must hold takes the short mask's place, and
items with fewer words than the span are seeded by such runs as well.

The benchmark side of the seed join is broadcast only when it holds at most
``MAX_BROADCAST_SEEDS`` rows (counted first; about 40 MB); beyond that it is
an ordinary shuffled join.  Seed windows are made in chunks of ``CHUNK``
words, so a very long text is never expanded at once.

Cases: null and empty texts have no words and never match; items with fewer
words than a mask's span are compared whole; rows that repeat a doc_id or item_id
are matched separately and reported once per (doc_id, item_id); null ids
are reported as null; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.llm.common import marked_rows, names, quoted, row_keys, scratch, written

MASKS = ("110110101", "101011011", "111000111")
SHORT_MASK = "11011"  # beside MASKS, for substitutions that leave them no window
WINDOW = 20
PERCENT = 80
CHUNK = 2048
MAX_BROADCAST_SEEDS = 1_000_000


def words(col):
    """Lower-case runs of letters and digits of a text, as an array."""
    return F.array_remove(F.split(F.lower(F.coalesce(col.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_codes(col):
    return F.transform(words(col), lambda w: F.xxhash64(w))


def shared_run(n: int, percent: int) -> int:
    """Length of a run of equal words that an overlap of ``n`` words with
    ``percent`` % equal ones must hold (its gaps cut the equal words into one
    run more than there are gaps)."""
    equal = max(1, -(-n * percent // 100))
    return -(-equal // (n - equal + 1))


def whole_masks(masks, window: int, percent: int) -> tuple:
    """``masks`` and what they need to meet every overlap that passes."""
    if (tuple(masks), window, percent) == (MASKS, WINDOW, PERCENT):
        return (*MASKS, SHORT_MASK)
    span = max(map(len, masks))
    return (*masks, "1" * min(shared_run(n, percent) for n in range(min(span, window), window + 1)))


def seed_rows(df: DataFrame, key: str, codes: str, masks=MASKS) -> DataFrame:
    """(key, pos, seed) for every mask and every window of its length."""
    span, least = max(map(len, masks)), min(map(len, masks))
    pieces = df.select(key, F.explode(F.transform(
        F.when(F.size(codes) >= least, F.sequence(F.lit(0), F.size(codes) - least, F.lit(CHUNK))).otherwise(F.array().cast("array<int>")),
        lambda s: F.struct(s.alias("at"), F.slice(F.col(codes), s + 1, F.lit(CHUNK + span - 1)).alias("part")))).alias("p"))
    pieces = pieces.select(key, "p.at", "p.part")
    n = F.least(F.greatest(F.size("part") - least + 1, F.lit(0)), F.lit(CHUNK))
    shifted = F.arrays_zip(*[F.slice("part", j + 1, n).alias(f"w{j}") for j in range(span)])
    rows = pieces.select(key, "at", F.posexplode(shifted).alias("i", "w"))
    # past the end of the text the words are null
    seeds = F.array(*[F.when(F.col(f"w.w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(mask), *[F.col(f"w.w{j}") for j, x in enumerate(mask) if x == "1"]))
                      for mask in masks])
    return rows.select(key, (F.col("at") + F.col("i")).alias("pos"), F.explode(seeds).alias("seed")).filter("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, matched, compared): each pair with a verified
    overlap, ``matched`` equal words of the best window of ``compared``."""
    return (row_leaks(docs, benchmark, masks, window, percent)
            .groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared")))


def row_leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """Verified overlaps with their document's row keys ``rk`` and ``rk2``, a pair once or more."""
    rk, rk2 = row_keys(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rk.alias("rk"), rk2.alias("rk2"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_codes(F.col("text")).alias("item"),
                             F.xxhash64("item_id", F.col("text").cast("string")).alias("ik")).dropDuplicates(["ik"])
    span, every = max(map(len, masks)), whole_masks(masks, window, percent)
    items = written(items.filter(F.size("item") >= 1))
    item_seeds = seed_rows(items.filter(F.size("item") >= span), "ik", "item", every)
    runs: dict[str, list[int]] = {}
    for (n,) in items.filter(F.size("item") < span).select(F.size("item")).distinct().collect():
        runs.setdefault("1" * shared_run(min(n, window), percent), []).append(n)
    for run, sizes in runs.items():
        item_seeds = item_seeds.union(seed_rows(items.filter(F.size("item").isin(sizes)), "ik", "item", (run,)))
    seeds = written(item_seeds.withColumnRenamed("pos", "item_pos").distinct())
    small = seeds.count() <= MAX_BROADCAST_SEEDS
    own = seed_rows(d.select("rk", word_codes(F.col("text")).alias("codes")), "rk", "codes", tuple(dict.fromkeys((*every, *runs))))
    hits = (own.join(F.broadcast(seeds) if small else seeds, "seed")
            .select("rk", "ik", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct())
    hits = written(hits)
    # the lost context comes back with the text of documents that were hit
    texts = d.join(hits.select("rk").distinct(), "rk", "left_semi").select("rk", "rk2", "doc_id", word_codes(F.col("text")).alias("doc"))
    laid = hits.join(items, "ik").join(texts, "rk")
    skip_doc, skip_item = F.greatest("diagonal", F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    n = F.least(F.size("doc") - skip_doc, F.size("item") - skip_item)
    laid = laid.select("rk", "rk2", "doc_id", "item_id", F.least(F.size("item"), F.lit(window)).alias("compared"), F.zip_with(
        F.slice("doc", skip_doc + 1, n), F.slice("item", skip_item + 1, n), lambda a, b: (a == b).cast("int")).alias("same")).filter(F.size("same") >= F.col("compared"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("compared") + 1), lambda i: F.aggregate(
        F.slice("same", i, F.col("compared")), F.lit(0), lambda total, x: total + x)))
    found = laid.select("rk", "rk2", "doc_id", "item_id", best.cast("long").alias("matched"), F.col("compared").cast("long").alias("compared"))
    return found.filter(F.col("matched") * 100 >= F.col("compared") * percent)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows without any leak, each judged by its own id and text (null
    and repeated ids too).  Only contaminated rows and a few others are shuffled."""
    k1, k2 = names(docs, "_row", 2)
    first, second = row_keys(docs)
    with scratch(docs.sparkSession) as keep:
        bad = keep(written(row_leaks(docs, benchmark, **how).select(F.col("rk").alias(k1), F.col("rk2").alias(k2)).distinct()))
    marked, others = marked_rows(docs.withColumn(k1, first).withColumn(k2, second), bad, k1, k2)
    columns = quoted(docs.columns)
    return others.select(*columns).union(marked.join(bad, [k1, k2], "left_anti").select(*columns))
