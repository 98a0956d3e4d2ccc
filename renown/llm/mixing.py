"""Mixing sources to target weights: temperature mixing by block permutations.

Token shares of the sources are raised to an exponent a and normalised.  The
exponent is bisected in [0, 1]: to the largest one whose weights have at least
``target_entropy`` (as a share of the entropy of equal weights), or to the
smallest one under which no source is repeated more than ``max_repeats`` times
within the budget; with both, the repetition limit wins.  Weights times budget
give each source a token quota.

A quota is realised by whole passes over the source plus one partial pass.
Each pass is a block permutation: documents fall into blocks by a hash of the
document and the pass, blocks and the documents in a block are ordered by
hashes.  A partial pass takes documents in that order while their places
begin before the quota's end.  Where it ends is one place per source: the
block from sums by block, the document from the sums of that block alone, so
texts are never shuffled and a source with a third of all rows is never
gathered in a task (blocks hold about ``BLOCK_DOCS`` documents).  Sorting by
pass, block and place gives the permutation.

Cases: tokens are white-space separated words; null and empty texts have no
tokens, and rows without tokens come once with every pass; a null source is a
source of its own; repeated rows (equal doc_id and text) are separate rows that
share a place and are drawn together; extra columns of any name and
type pass through, but for those named like an added column (in either case),
which the added one replaces; sources without any token get weight 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renown.llm.common import names, quoted, written

BLOCK_DOCS = 4096
MAX_REPEATS = 1.25
BUDGET = 1.0  # tokens to draw, as a multiple of the corpus


def weights(tokens: list[float], a: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** a if t > 0 else 0.0 for t in tokens]
    return [x / sum(raw) for x in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def bisect_exponent(tokens: list[float], budget: float, max_repeats: float | None, target_entropy: float | None) -> float:
    """The exponent; feasibility is monotone in it for either goal."""
    full = math.log(max(2, sum(t > 0 for t in tokens)))
    if max_repeats is not None:
        ok = lambda a: max(budget * w / t for w, t in zip(weights(tokens, a), tokens, strict=True) if t > 0) <= max_repeats
        at_zero, at_one = ok(0.0), True  # at 1 all sources repeat equally: the best there is
    elif target_entropy is not None:
        ok = lambda a: entropy(weights(tokens, a)) < target_entropy * full
        at_zero, at_one = ok(0.0), ok(1.0)
    else:
        return 1.0
    if at_zero:
        return 0.0
    if not at_one:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi if max_repeats is not None else lo


def source_weights(docs: DataFrame, budget: float = BUDGET, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None):
    """Rows (source, docs, tokens, weight, quota), one per source; the number
    of sources is taken to fit the driver, nothing per document does."""
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).collect()
    sums = sorted(sums, key=lambda r: (r["source"] is not None, r["source"] or ""))
    tokens = [float(r["tokens"] or 0) for r in sums]
    if not sum(tokens):
        return [(r["source"], r["docs"], 0, 0.0, 0) for r in sums]
    draw = budget * sum(tokens)
    w = weights(tokens, bisect_exponent(tokens, draw, max_repeats, target_entropy))
    return [(r["source"], r["docs"], r["tokens"], x, int(round(x * draw))) for r, x in zip(sums, w, strict=True)]


def counted(docs: DataFrame) -> DataFrame:
    """(source, n_tokens, _key) of every row."""
    return docs.select(F.col("source").cast("string").alias("source"), token_count().alias("n_tokens"), document_key().alias("_key"))


def token_count():
    words = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(words, "")).cast("long")


def document_key():
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def places(key, number, blocks, seed: int):
    """The order of a pass: (block, place) by hashes of block and document."""
    block = F.pmod(F.xxhash64(key, number, F.lit(seed)), blocks)
    return F.struct(F.xxhash64(block, number, F.lit(seed + 1)).alias("block"), F.xxhash64(key, number, F.lit(seed + 2)).alias("place"), key.alias("key"))


def _first_reaching(sums: DataFrame, order: str) -> DataFrame:
    """Per source the last of its places, in ``order``, that begins before the
    quota, and the quota left there."""
    w = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("quota", F.col("quota") - F.coalesce(F.sum("tokens").over(w), F.lit(0))).filter("quota > 0")
    return begun.groupBy("source").agg(F.max(F.struct(order, "quota")).alias("end")).select("source", f"end.{order}", "end.quota")


ADDED = ("n_tokens", "pass", "block", "place", "weight")


def mix(docs: DataFrame, budget: float = BUDGET, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """The drawn rows: every input column plus n_tokens, pass (from 0), block
    (its order in the pass), place (the order in the block) and weight; an
    input column of one of these names is replaced."""
    spark = docs.sparkSession
    slim = written(counted(docs))
    plan = source_weights(slim, budget, max_repeats, target_entropy)
    # the partial pass of every source: its number, quota and number of blocks; one row per source
    partial = [(s, quota // t, quota % t, max(1, -(-n // BLOCK_DOCS))) for s, n, t, _, quota in plan if t and quota % t]
    part = spark.createDataFrame(partial, "_source string, pass long, quota long, blocks long")
    rows = (slim.join(F.broadcast(part), F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("at", places(F.col("_key"), F.col("pass"), F.col("blocks"), seed)))
    by_block = rows.groupBy("source", "quota", F.col("at.block").alias("block")).agg(F.sum("n_tokens").alias("tokens"))
    ends = _first_reaching(by_block, "block").toDF("_s", "_b", "left")
    ends = spark.createDataFrame(ends.collect(), ends.schema)  # one row per source
    last = rows.join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("_s")) & (F.col("at.block") == F.col("_b")))
    by_place = last.groupBy("source", F.col("left").alias("quota"), "at").agg(F.sum("n_tokens").alias("tokens"))
    stop = {r["source"]: r["at"] for r in _first_reaching(by_place, "at").collect()}
    passes = []
    for source, n, t, weight, quota in plan:
        whole = [(p, None) for p in range(quota // t if t else 1)]
        passes.append((source, max(1, -(-n // BLOCK_DOCS)), float(weight), whole + ([((quota // t), stop[source])] if source in stop else [])))
    dim = spark.createDataFrame(passes, "_source string, _blocks long, weight double, _passes array<struct<pass:long, stop:struct<block:long, place:long, key:long>>>")
    columns = quoted(c for c in docs.columns if c.lower() not in ADDED)
    key, source, p, at, n, w, blocks, todo = (names(docs, x)[0] for x in ("key", "source", "p", "at", "n", "w", "blocks", "todo"))
    drawn = (docs.select(*columns, token_count().alias(n), document_key().alias(key))
             .join(F.broadcast(dim.toDF(source, blocks, w, todo)), F.col("source").cast("string").eqNullSafe(F.col(source)))
             .withColumn(p, F.explode(todo))
             .withColumn(at, places(F.col(key), F.col(p)["pass"], F.col(blocks), seed)))
    return (drawn.filter(F.col(p)["stop"].isNull() | (F.col(at) <= F.col(p)["stop"]))
            .select(*columns, F.col(n).alias("n_tokens"), F.col(p)["pass"].alias("pass"), F.col(at)["block"].alias("block"),
                    F.col(at)["place"].alias("place"), F.col(w).alias("weight")))
