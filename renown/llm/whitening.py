"""Embedding whitening with MLlib's distributed block matrices.

Every vector entry c becomes the integer x = floor(1024 c) + 100000.  Sums per
dimension are exact integers; a row is centred as (n x - S) / n, so the only
rounding is that of one division.

1. Rows are written in blocks of consecutive rows of a partition; a block's
   index is its place there plus the partition's offset.  The centred blocks
   (a partition's last one filled up with zero rows) are a ``BlockMatrix``.
2. ``blocks.transpose() * blocks`` is the scatter matrix.  The sum over rows is
   split into as many tasks as hold ``TASK_BYTES`` of blocks each; what comes to
   the driver is one matrix of dimensions x dimensions.
3. Its eigenvectors (``numpy.linalg.eigh``), divided by the square roots of
   the eigenvalues, are the whitening matrix; blocks times it are the whitened
   rows, which meet their ids block by block.

The driver holds one offset a partition, one entry a block (blocks grow with
the input up to ``BLOCK_BYTES``) and the scatter matrix.

Cases: rows whose vector is null or holds null, NaN or infinite entries are
dropped, and so are empty vectors and vectors of another length than the most
frequent one (ties: the longest), which have no place in the matrix.  Entries
beyond +-2**42 count as +-2**42.  Rows that repeat a vec_id, or have a null
one, are rows of their own.  A component without variance (one row only, equal
rows, fewer rows than components) cannot be whitened: its ``whitened`` is null,
and it stays out of ``identity_error``, which is null when no component has
variance.  ``deviation`` is decimal(38,0), null beyond that.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from renown.llm.common import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 42)
BLOCK_BYTES = 1 << 25
TASK_BYTES = 1 << 26
DIGITS = 10**38
HALF = 26  # bits of the lower part of a sum

# a block as Spark stores it: index and dense matrix, rows one after another
AT = StructType([StructField("row", LongType()), StructField("col", LongType())])
BLOCK = StructType([StructField("at", AT), StructField("part", MatrixUDT())])
ARROW_AT = pa.struct([("row", pa.int64()), ("col", pa.int64())])
ARROW_PART = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                        ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the usable rows."""
    c = F.col("embedding").cast("array<double>")
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    entry = lambda v: (F.floor(F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE) + SHIFT).cast("long")
    return vectors.filter(usable).select("vec_id", F.transform(c, entry).alias("x"))


def _flat(batch, name: str, dims: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(values, width: int):
    """A list column of rows of ``width`` values."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // width + 1, dtype=np.int32) * width), values)


def row_blocks(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """(at, ids, x): blocks of up to ``size`` rows, written once so that every
    later pass sees the same blocks; x holds the rows one after another."""
    def run(batches):
        p, b, ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def emit():
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([b], pa.int64()), _lists(pa.concat_arrays(ids), len(x)), _lists(pa.array(x.ravel()), x.size)],
                                              ["p", "b", "ids", "x"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                ids.append(part.column("vec_id"))
                held.append(_flat(part, "x", dims))
                n, at = n + part.num_rows, at + part.num_rows
                if n == size:
                    yield emit()
                    ids, held, n, b = [], [], 0, b + 1
        if n:
            yield emit()

    kept = rows.schema["vec_id"].dataType.simpleString()
    table = written(rows.mapInArrow(run, f"p int, b long, ids array<{kept}>, x array<long>"))
    counts = table.groupBy("p").count().orderBy("p").collect()
    starts = np.concatenate([[0], np.cumsum([r["count"] for r in counts])[:-1]]).tolist()
    offsets = rows.sparkSession.createDataFrame([(r["p"], int(s)) for r, s in zip(counts, starts, strict=True)], "p int, start long")
    return table.join(F.broadcast(offsets), "p").select((F.col("start") + F.col("b")).alias("at"), "ids", "x")


def dimension_sums(blocks: DataFrame, dims: int) -> list:
    """(dim, n, s, lo, hi) of every dimension, exact."""
    def run(batches):
        for batch in batches:
            for x in batch.column("x"):
                x = x.values.to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, len(x))), pa.array((x >> HALF).sum(0)), pa.array((x & (2**HALF - 1)).sum(0)),
                                                  pa.array(x.min(0)), pa.array(x.max(0))], ["dim", "n", "upper", "lower", "lo", "hi"])

    exact = {c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("upper", "lower")}
    rows = (blocks.select("x").mapInArrow(run, "dim long, n long, upper long, lower long, lo long, hi long").groupBy("dim")
            .agg(F.sum("n").alias("n"), *exact.values(), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").collect())
    return [(r["n"], (int(r["upper"]) << HALF) + int(r["lower"]), r["lo"], r["hi"]) for r in rows]


def centred_blocks(blocks: DataFrame, n: int, sums: list[int], size: int, n_blocks: int, kind) -> BlockMatrix:
    """The rows (n x - S) / n as a distributed matrix."""
    total, dims = np.array(sums, dtype=kind), len(sums)

    def run(batches):
        for batch in batches:
            for at, x in zip(batch.column("at").to_pylist(), batch.column("x"), strict=True):
                x = x.values.to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)
                v = np.zeros((size, dims))
                v[:len(x)] = (n * x - total) / n
                fields = [pa.array([1], pa.int8()), pa.array([size], pa.int32()), pa.array([dims], pa.int32()), pa.array([None], pa.list_(pa.int32())),
                          pa.array([None], pa.list_(pa.int32())), _lists(pa.array(v.ravel()), v.size), pa.array([True])]
                yield pa.RecordBatch.from_arrays([pa.array([{"row": at, "col": 0}], ARROW_AT), pa.StructArray.from_arrays(fields, fields=list(ARROW_PART))], ["at", "part"])

    return _matrix(blocks.select("at", "x").mapInArrow(run, BLOCK), size, dims, n_blocks)


def _matrix(blocks: DataFrame, size: int, dims: int, n_blocks: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, size, dims, n_blocks * size, dims), size, dims)


def deviations(blocks: DataFrame, n: int, sums: list[int], kind) -> DataFrame:
    """(at, ids, deviation) of every block: exact sums of (n x - S) ** 2."""
    total, dims = np.array(sums, dtype=kind), len(sums)

    def run(batches):
        for batch in batches:
            for i, x in enumerate(batch.column("x")):
                d = n * x.values.to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind) - total
                square = (d * d).sum(axis=1)
                exact = (pa.array(square).cast(pa.decimal128(38, 0)) if kind is np.int64 else
                         pa.array([Decimal(int(s)) if s < DIGITS else None for s in square], pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays([batch.column("at").slice(i, 1), batch.column("ids").slice(i, 1), _lists(exact, len(exact))], ["at", "ids", "deviation"])

    kept = blocks.schema["ids"].dataType.simpleString()
    return blocks.mapInArrow(run, f"at long, ids {kept}, deviation array<decimal(38,0)>")


def scatter(spark, blocks: BlockMatrix) -> np.ndarray:
    """blocks^T * blocks, summed over rows in many tasks."""
    per_task = max(1, TASK_BYTES // (8 * blocks.rowsPerBlock * blocks.colsPerBlock))
    splits = max(-(-blocks.numRowBlocks // per_task), min(blocks.numRowBlocks, spark.sparkContext.defaultParallelism))
    # the Python class has no argument for the number of splits of the summed dimension
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    out = BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (out + out.T) / 2


def whitening_matrix(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions x k matrix, k eigenvalues), largest first; columns of
    components without variance are zero, as is their eigenvalue."""
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    e = np.where(e > max(e[0], 0) * len(covariance) * 1e-14, e, 0.0)
    return np.divide(u, np.sqrt(e), out=np.zeros_like(u), where=e > 0), e


def projected(spark, blocks: BlockMatrix, matrix: np.ndarray, ids: DataFrame) -> DataFrame:
    """(vec_id, deviation, w) of the rows of blocks * matrix, read from its
    blocks (MLlib's conversion to indexed rows counts rows in 32 bits)."""
    dims, k = matrix.shape
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, k, matrix.ravel("F").tolist()))], 1), dims, k)
    parts = callMLlibFunc("getMatrixBlocks", blocks.multiply(right)._java_matrix_wrapper._java_model).toDF("place", "part")

    def run(batches):
        for batch in batches:
            for i, part in enumerate(batch.column("part")):
                # a product with a dense block is dense; values stand by columns unless transposed
                rows, values = part["numRows"].as_py(), part["values"].values.to_numpy()
                w = values.reshape(rows, k) if part["isTransposed"].as_py() else values.reshape(k, rows).T
                own, exact = (batch.column(c)[i].values for c in ("ids", "deviation"))
                yield pa.RecordBatch.from_arrays([own, exact, _lists(pa.array(np.ascontiguousarray(w[:len(own)]).ravel()), k)], ["vec_id", "deviation", "w"])

    kept = ids.schema["ids"].dataType.elementType.simpleString()
    both = ids.join(parts.select(F.col("place")["_1"].cast("long").alias("at"), "part"), "at")
    return both.select("ids", "deviation", "part").mapInArrow(run, f"vec_id {kept}, deviation decimal(38,0), w array<double>")


def identity_error(rows: DataFrame, filled: list[int]) -> float | None:
    """Largest absolute entry of (covariance of w) - identity, over the
    components in ``filled``; centred before multiplying, divisor n."""
    if not filled:
        return None
    mean = rows.agg(*[F.avg(F.col("w")[j]).alias(f"m{j}") for j in filled]).first()
    part = {j: F.col("w")[j] - F.lit(mean[f"m{j}"]) for j in filled}
    pairs = [(i, j) for i in filled for j in filled if i <= j]
    cov = rows.agg(*[F.avg(part[i] * part[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    of every usable row and its first ``k`` components."""
    spark = vectors.sparkSession
    rows = integer_rows(vectors)
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    kept = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kept}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims, n = lengths
    size = max(1, min(max(256, n // 4096), BLOCK_BYTES // (8 * dims)))
    blocks = row_blocks(rows.filter(F.size("x") == dims), dims, size)
    stats = dimension_sums(blocks, dims)
    sums = [s for _, s, _, _ in stats]
    widest = max(max(n * hi - s, s - n * lo) for _, s, lo, hi in stats)
    fits = dims * widest**2 < 2**63 and all(n * max(abs(lo), abs(hi)) < 2**62 for _, _, lo, hi in stats)
    kind = np.int64 if fits else object
    matrix = centred_blocks(blocks, n, sums, size, blocks.count(), kind)
    covariance = scatter(spark, matrix) / n
    whitening, e = whitening_matrix(covariance, k)
    trace = float(np.trace(covariance))
    table = written(projected(spark, matrix, whitening, deviations(blocks, n, sums, kind)))
    error = identity_error(table, [j for j in range(len(e)) if e[j] > 0])
    parts = F.array(*[F.struct(F.lit(j + 1).alias("component"), (F.col("w")[j] if e[j] > 0 else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(float(e[j]) / trace if trace > 0 else None).cast("double").alias("explained")) for j in range(len(e))])
    return table.select("vec_id", "deviation", F.explode(parts).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
