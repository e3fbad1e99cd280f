"""Operator 5: exact top-k search with multi-resolution segment statistics.

A vector is cut into segments; from the means and deviations of the segments of two vectors follows
a lower bound of their distance (Cauchy-Schwarz inside each segment), and so an upper bound of their
inner product. Bounds are taken coarse to fine, for each query by itself; a vector whose bound does not
reach a query's k-th best score so far is left out, and exact integer products are computed for the
survivors. Vectors are turned to a basis that gathers their energy in the first components (an
orthogonal map, which keeps inner products), and the finer resolutions take these singly: their part of the
product is exact, is carried from one resolution to the next, and only the rest is bounded by segments. The
first thresholds come from one block of vectors for each length, scored before the search; the basis is learned
from that block, and so is which resolutions are worth their cost: one that would exclude fewer of its pairs than
it costs is left out. None of this can change the result.

Queries and vectors travel in packed blocks of bounded size. A task gets one block of queries and a
stripe of STRIPE_BYTES of vector blocks, so neither side is broadcast and no pair of rows is ever emitted; its
answer is k rows for each query, of which a window keeps the best. Every query meets every vector, so
vectors are shuffled once for each QUERY_BYTES of queries, and queries once for each STRIPE_BYTES of vectors.

Rows: vectors that are null or hold null or non-finite components, and rows without vec_id, take no
part. Vectors are compared with those of equal length only; a very long one is a row of its block, with
fewer rows in a block. Rows that share a vec_id are the same vector to a query of that id (none is its
candidate) and separate candidates to others; an empty vector scores 0. Ties go to the smaller vec_id.
Scores beyond a long are cut to its range. Other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TOP = 5
SCALE = 256
QUERY_EVERY = 50
QUERY_BYTES = 32 << 20  # of the queries of a task
STRIPE_BYTES = 128 << 20  # of the vectors of a task
QUERIES_AT_ONCE = 1024
VECTOR_BLOCK = 1024
VECTOR_BYTES = 4 << 20
TURNED = 512  # longer vectors are not turned
SPARSE = 0.3  # with fewer survivors than this, pairs are multiplied one by one


class Level(NamedTuple):
    """A resolution: how many leading components are taken singly, and where the segments of the others begin."""

    head: int
    starts: list[int]

    def statistics(self, turned: np.ndarray) -> np.ndarray:
        return _statistics(turned[:, self.head :], self.starts)

    def cost(self) -> int:
        """Multiplications of its bound for a pair, besides the leading components."""
        return 2 * len(self.starts)


def resolutions(dim: int) -> list[list[int]]:
    """Where the segments of each resolution begin, coarse to fine; the last ones take leading components singly."""
    even = [list(range(0, dim, -(-dim // s))) for s in (4, 16) if dim > s]
    return even + [[*range(head), *range(head, dim, max(1, -(-(dim - head) // 4)))] for head in (dim // 2, dim * 3 // 4) if dim >= 16]


def levels_of(dim: int) -> list[Level]:
    out = []
    for starts in resolutions(dim):
        head = 0
        while head + 1 < len(starts) and starts[head + 1] == head + 1:
            head += 1
        out.append(Level(head, [v - head for v in starts[head:]]))
    return out


def worth(q: np.ndarray, x: np.ndarray, least: np.ndarray, basis: np.ndarray | None) -> list[int]:
    """Which resolutions save more multiplications of a pair than they cost, as far as these vectors tell."""
    turned = (lambda v: v @ basis) if basis is not None else (lambda v: v)
    q, x, dim = turned(q), turned(x), q.shape[1]
    open_ = least > -np.inf
    kept = []
    for n, level in enumerate(levels_of(dim)):
        bound = q[open_, : level.head] @ x[:, : level.head].T + level.statistics(q[open_]) @ level.statistics(x).T
        excluded = float((bound < least[open_, None]).mean()) if bound.size else 0.0
        if excluded * (dim - level.head) > level.cost():
            kept.append(n)
    return kept


def _packed(vectors: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """dim, n, ids, values: blocks of whole-number vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["dim", "n", "ids", "values"])

        for b in batches:
            lists = b.column("x")
            lengths = lists.value_lengths().to_numpy()
            ids = b.column("vec_id").to_numpy()
            flat = np.floor(lists.flatten().to_numpy() * SCALE)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                rows_a_block = max(1, min(most_rows, most_bytes // (8 * max(1, int(dim)))))
                rows = np.flatnonzero(lengths == dim)
                x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                held = waiting.setdefault(int(dim), [])
                held.append((ids[rows], x))
                i, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                full = len(i) // rows_a_block * rows_a_block
                for at in range(0, full, rows_a_block):
                    yield block(int(dim), i[at : at + rows_a_block], x[at : at + rows_a_block])
                waiting[int(dim)] = [(i[full:], x[full:])]
        for dim, held in waiting.items():
            for i, x in held:
                if len(i):
                    yield block(dim, i, x)

    return vectors.mapInArrow(run, "dim int, n int, ids binary, values binary")


def _statistics(x: np.ndarray, starts: list[int]) -> np.ndarray:
    """Rows whose inner products are upper bounds of those of x: weighted means and deviations of the segments."""
    width = np.diff([*starts, x.shape[1]])
    total = np.add.reduceat(x, starts, axis=1) if len(starts) else np.zeros((len(x), 0))
    mean = total / np.sqrt(width)
    wide = width > 1
    squares = np.add.reduceat(x * x, starts, axis=1)[:, wide] if len(starts) else mean[:, wide]
    return np.concatenate([mean, np.sqrt(np.maximum(squares - mean[:, wide] ** 2, 0))], axis=1)


def basis_of(x: np.ndarray) -> np.ndarray:
    """An orthogonal basis, the directions of most energy first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; floats hold them exactly below 2**53, Python's integers beyond."""
    if q.size and x.size and q.shape[1] * np.abs(q).max() * np.abs(x).max() >= 2.0**53:
        big = np.vectorize(int, otypes=[object])
        return np.clip(big(q) @ big(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return (q @ x.T).astype(np.int64)


class _Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.rows, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)
        self.exact = 0  # products computed

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == -(1 << 63) else -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[rows[last]] = np.maximum(self.least[rows[last]], scores[last])
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]


def search_block(query_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None, basis: np.ndarray | None = None, use: list[int] | None = None) -> _Best:
    """The k best of the blocks' vectors for each query, as far as they reach `least`; `use` names the resolutions to try, all if None."""
    best = _Best(len(q), k)
    if least is not None:
        best.least = least.astype(float)
    levels = [v for n, v in enumerate(levels_of(q.shape[1])) if use is None or n in use]
    turned = (lambda v: v @ basis) if basis is not None and levels else (lambda v: v)
    tq = turned(q)
    of_q = [v.statistics(tq) for v in levels]
    norm = np.sqrt((q * q).sum(axis=1))
    for ids, x in blocks:
        slack = 1e-9 * norm.max(initial=0) * np.sqrt((x * x).sum(axis=1)).max(initial=0) + 1e-6
        tx = turned(x)
        of_x = [v.statistics(tx) for v in levels]
        for at in range(0, len(q), QUERIES_AT_ONCE):
            rows = np.arange(at, min(len(q), at + QUERIES_AT_ONCE))
            columns = np.arange(len(ids))
            reach, exact, done = query_ids[rows, None] != ids[None, :], np.zeros((len(rows), len(ids))), 0
            for level, sq, sx in zip(levels, of_q, of_x):
                if level.head > done:
                    exact = exact + tq[rows, done : level.head] @ tx[columns, done : level.head].T
                    done = level.head
                reach = reach & (exact + sq[rows] @ sx[columns].T + slack >= best.least[rows, None])
                some, left = reach.any(axis=1), reach.any(axis=0)
                if some.sum() * left.sum() < 0.5 * reach.size:
                    rows, columns, reach, exact = rows[some], columns[left], reach[np.ix_(some, left)], exact[np.ix_(some, left)]
            if not reach.size:
                continue
            i, j = np.nonzero(reach)
            if len(i) < SPARSE * reach.size and q.shape[1] * np.abs(q).max() * np.abs(x).max() < 2.0**53:
                best.exact += len(i)
                scores = np.concatenate([np.einsum("ij,ij->i", q[rows[i[p : p + 65536]]], x[columns[j[p : p + 65536]]]) for p in range(0, max(1, len(i)), 65536)]).astype(np.int64)
            else:
                best.exact += reach.size
                scores = _exact(q[rows], x[columns])[i, j]
            ok = scores >= best.least[rows[i]]
            best.add(rows[i[ok]], ids[columns[j[ok]]], scores[ok])
    return best


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["values"], np.float64).reshape(row["n"], row["dim"])


def _seeded(query_blocks: DataFrame, k: int) -> DataFrame:
    """Query blocks with the threshold of each query, and the basis, of their `first` block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.to_pylist():
                ids, q = _unpacked(one)
                first_ids, x = _unpacked({**one["first"], "dim": one["dim"]})
                best = search_block(ids, q, [(first_ids, x)], k, use=[])
                basis = basis_of(x) if 0 < x.shape[1] <= TURNED else None
                use, turn = worth(q, x, best.least, basis), None if basis is None else basis.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((one["q"], pa.int64()), (one["dim"], pa.int32()), (one["n"], pa.int32()), (one["ids"], pa.binary()), (one["values"], pa.binary()), (best.least.tobytes(), pa.binary()), (turn, pa.binary()), (use, pa.list_(pa.int32())))],
                    names=["q", "dim", "n", "ids", "values", "least", "basis", "use"],
                )

    return query_blocks.mapInArrow(run, "q long, dim int, n int, ids binary, values binary, least binary, basis binary, use array<int>")


def top_scores(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of `vec_id, embedding`: the rows whose vec_id `every` divides, against all."""
    spark = embeddings.sparkSession
    x = F.col("embedding").cast("array<double>")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    queries = vectors.filter(F.col("vec_id") % every == 0)
    vector_blocks = written(_packed(vectors, VECTOR_BLOCK, VECTOR_BYTES).withColumn("v", F.monotonically_increasing_id()), "vector-blocks")
    size = queries.agg(F.sum(F.size("x")).alias("s")).first()["s"] or 0
    query_blocks = _packed(queries.repartition(max(1, -(-8 * size // QUERY_BYTES))), 1 << 30, QUERY_BYTES).withColumn("q", F.monotonically_increasing_id())
    first = vector_blocks.groupBy("dim").agg(F.max_by(F.struct("n", "ids", "values"), "n").alias("first"))
    query_blocks = written(_seeded(query_blocks.join(first, "dim"), k), "query-blocks")
    held = vector_blocks.agg(F.sum(F.col("n").cast("long") * F.col("dim") * 8).alias("s")).first()["s"] or 0
    stripes = max(1, -(-held // STRIPE_BYTES), spark.sparkContext.defaultParallelism)
    numbers = query_blocks.select("dim", F.col("q").alias("with"))
    left = query_blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    right = vector_blocks.withColumn("stripe", F.pmod(F.xxhash64("v"), F.lit(stripes))).join(numbers, "dim").withColumnRenamed("with", "q")  # a vector block for each query block

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        blocks = [_unpacked(r) for r in b.to_pylist()]
        for one in a.to_pylist():
            ids, q = _unpacked(one)
            turn = np.frombuffer(one["basis"], np.float64).reshape(q.shape[1], -1) if one["basis"] else None
            best = search_block(ids, q, blocks, k, np.frombuffer(one["least"], np.float64), turn, one["use"])
            rows.append((ids[best.rows], best.ids, best.scores))
        cols = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = left.groupBy("dim", "q", "stripe").cogroup(right.groupBy("dim", "q", "stripe")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
