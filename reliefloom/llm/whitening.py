"""Operator 11: embedding whitening with distributed block matrices of Spark MLlib.

Entries become integers, x = floor(64 c) + 1000000, so that counts, sums and deviations are exact. Centred
rows are written as indexed blocks of some hundred rows; the block matrix times its transpose is the scatter,
whose eigenvectors the driver takes (dimension squared, whatever the rows); another product with the
whitening matrix projects all rows. Blocks come from and go to Parquet in the shared folder, as matrix columns.

- The scatter is one block, so its product is split over the middle dimension: each task multiplies some
  row blocks, and only blocks of dimension squared are summed.
- For the projection, row blocks stand on a square grid, times a block diagonal of copies of the whitening
  matrix: MLlib cuts a tall matrix into the root of its partitions only, a square one into all.
- The last block of each task is filled up with rows of zeros, which add nothing to a scatter.

Rows: those whose vector is null, or holds null or non-finite entries, are dropped, and so are vectors of
another length than most rows have (of the longer, if two lengths are equally common); without entries there
is nothing to return. Equal vec_ids and repeated rows are rows of their own; a null vec_id stays null. Entries
beyond 9.2e18 / 64 stand there, and a deviation beyond a long is null. Components whose eigenvalue is
zero to rounding can't be scaled and are left out: a single row, or equal rows, give none. Equal
eigenvalues have components in any order. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parallelism, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FURTHEST = 9.2e18
BLOCK_BYTES = 4 << 20
MATRIX = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("m", MatrixUDT())])
#: The columns that a matrix has in a table.
PLAIN = "struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, values: array<double>, isTransposed: boolean>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    e = F.col("embedding")
    odd = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(e, lambda c: F.floor(F.least(F.greatest(SCALE * c.cast("double"), F.lit(-FURTHEST)), F.lit(FURTHEST))) + SHIFT)
    return embeddings.filter(e.isNotNull() & ~odd & (F.size(e) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of the commonest length, and their sum in each dimension: sums of dimensions come to the driver, not rows."""
    each = rows.select(F.size("x").alias("d"), F.posexplode("x").alias("at", "v"))
    sums = each.groupBy("d", "at").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = sums.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("s"))
    best = sums.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return (best[0]["n"], [int(x["s"]) for x in best[0]["s"]]) if best else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S, and the sum of its squares in each row (null beyond a long), both exact."""
    most, d = max(abs(int(x.max())), abs(int(x.min()))), len(sums)
    wide = n * most + max(map(abs, sums)) >= 1 << 62
    off = n * x.astype(object if wide else np.int64) - np.array(sums, object if wide else np.int64)
    if not wide and d * int(np.abs(off).max()) ** 2 < 1 << 63:
        return off, (off * off).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in off.tolist()]
    return off, [v if v < 1 << 63 else None for v in exact]


def centred_blocks(rows: DataFrame, n: int, sums: list[int], block_rows: int) -> DataFrame:
    """part, k, vec_ids, deviations and the centred rows as a matrix `m` of block_rows rows, row by row."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                ids, lists = b.column(0).slice(at, block_rows), b.column(1).slice(at, block_rows)
                off, squares = deviations(lists.flatten().to_numpy().reshape(-1, d), n, sums)
                values = np.zeros((block_rows, d))
                values[: len(off)] = (off / n).astype(np.float64)
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                none = pa.nulls(1, pa.list_(pa.int32()))
                cells = [pa.array([1], pa.int8()), pa.array([block_rows], pa.int32()), pa.array([d], pa.int32()), none, none, one(pa.array(values.ravel())), pa.array([True])]
                m = pa.StructArray.from_arrays(cells, ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), one(ids), one(pa.array(squares, pa.int64())), m], names=["part", "k", "vec_ids", "deviations", "m"])
                k += 1

    return rows.filter(F.size("x") == d).mapInArrow(run, f"part int, k int, vec_ids array<long>, deviations array<long>, m {PLAIN}")


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with `g`, from 0 without gaps: a row for each task that wrote some is ordered, not the blocks."""
    parts = blocks.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return blocks.join(parts.select("part", before.alias("first")), "part").withColumn("g", F.col("first") + F.col("k")).drop("first")


def block_matrix(blocks: DataFrame, rows: str, columns: str, shape: tuple[int, int], grid: tuple[int, int]) -> BlockMatrix:
    """A block matrix of a table with a matrix column `m`; rows and columns are the expressions of a block's place."""
    placed = blocks.select(F.struct(F.expr(rows).cast("long").alias("i"), F.expr(columns).cast("long").alias("j")).alias("at"), "m")
    made = callMLlibFunc("createBlockMatrix", placed, shape[0], shape[1], grid[0] * shape[0], grid[1] * shape[1])
    return BlockMatrix(made, *shape)


def scatter(tall: BlockMatrix, pieces: int) -> np.ndarray:
    """The transpose times the matrix, its long middle dimension dealt over `pieces` tasks."""
    made = tall.transpose()._java_matrix_wrapper.call("multiply", tall._java_matrix_wrapper._java_model, pieces)
    return BlockMatrix(made, tall.colsPerBlock, tall.colsPerBlock).toLocalMatrix().toArray()


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit eigenvectors as columns."""
    e, q = np.linalg.eigh((v + v.T) / 2)
    e, q = e[::-1], q[:, ::-1]
    k = int((e > max(e[0], 0.0) * len(e) * np.finfo(float).eps).sum()) if len(e) and e[0] > 0 else 0
    return e[: min(k, most)], q[:, : min(k, most)]


def whitened(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    spark = embeddings.sparkSession
    rows = integers(embeddings)
    n, sums = moments(rows)
    if not n:
        return spark.createDataFrame([], RESULT)
    d, tasks = len(sums), parallelism(spark)
    block_rows = max(1, min(BLOCK_BYTES // (8 * d), -(-n // (4 * tasks)), int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    blocks = written(centred_blocks(rows, n, sums, block_rows), "whitening-rows")
    n_blocks = blocks.count()
    path = blocks.inputFiles()
    side = math.isqrt(n_blocks - 1) + 1
    wide = -(-n_blocks // side)
    as_matrices = numbered(spark.read.schema(MATRIX).parquet(*path))
    v = scatter(block_matrix(as_matrices, "g", "0", (block_rows, d), (n_blocks, 1)), tasks) / n
    e, q = components(v, most)
    if not len(e):
        return spark.createDataFrame([], RESULT)
    k = len(e)
    diagonal = DenseMatrix(d, k, (q / np.sqrt(e)).ravel(order="F"))
    copies = BlockMatrix(spark.sparkContext.parallelize([((c, c), diagonal) for c in range(wide)], 1), d, k, wide * d, wide * k)
    on_grid = block_matrix(as_matrices, f"g % {side}", f"g div {side}", (block_rows, d), (side, wide))
    projected = callMLlibFunc("getMatrixBlocks", on_grid.multiply(copies)._java_matrix_wrapper._java_model).toDF("at", "m")
    projected = projected.select((F.col("at._2").cast("long") * side + F.col("at._1")).alias("g"), "m")
    return _rows_of(blocks, written(projected, "whitening-projected"), n, e, float(np.trace(v)), block_rows, tasks, n_blocks)


def _rows_of(blocks: DataFrame, projected: DataFrame, n: int, e: np.ndarray, trace: float, block_rows: int, tasks: int, n_blocks: int) -> DataFrame:
    spark, k = blocks.sparkSession, len(e)
    # the projections of centred rows are centred: their scatter over n is their covariance
    identity_error = float(np.abs(scatter(block_matrix(projected, "g", "0", (block_rows, k), (n_blocks, 1)), tasks) / n - np.eye(k)).max())
    explained = e / trace
    values = spark.read.schema(f"g long, m {PLAIN}").parquet(*projected.inputFiles()).select("g", "m.values", "m.isTransposed")
    joined = numbered(blocks.select("part", "k", "vec_ids", "deviations")).join(values, "g").select("vec_ids", "deviations", "values", "isTransposed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, squares = b.column(0).slice(r, 1).flatten(), b.column(1).slice(r, 1).flatten()
                y = b.column(2).slice(r, 1).flatten().to_numpy().reshape((block_rows, k), order="C" if b.column(3)[r].as_py() else "F")[: len(ids)]
                each = pa.array(np.repeat(np.arange(len(ids)), k))
                own, total = np.tile(np.arange(k), len(ids)), len(ids) * k
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(own + 1, pa.int32()), pa.array(np.full(total, n)), squares.take(each), pa.array(np.ascontiguousarray(y).ravel()), pa.array(explained[own]), pa.array(np.full(total, identity_error))],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return joined.mapInArrow(run, RESULT)
