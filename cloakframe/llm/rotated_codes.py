"""Nearest neighbours by randomly rotated one-bit codes (RaBitQ; Gao & Long, 2024).

Vectors are taken relative to the mean of all, scaled to length one, rotated by a random
orthogonal matrix, and kept as the signs of the components, packed. With the norm and the
inner product of vector and code as correction scalars, a query's inner product with every
vector is estimated from the bits, with a bound on the error. Vectors whose lower bound of the
distance is within the k-th smallest upper bound so far are reranked on the original vectors.

Queries are a stated set; they are met by all rows in blocks. A block of queries has at
most QUERIES rows and goes to the data. Each task keeps the best k of each query.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another dimension than the query's aren't candidates;
rows that repeat an id count once (the least vector); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import cut
from cloakframe.llm.vectors import by_dimension, one_row_each, random_matrix, usable

BLOCK, QUERIES = 4096, 1024
#: Multiple of the estimate's standard deviation, about, that the bounds allow for.
EPSILON = 4.0
#: With up to this many blocks of queries (17 MB at 512 dimensions a block of 4 MB), they are broadcast.
FEW = 16


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(random_matrix(7, d, d))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, norms, inner products of unit vector and code)."""
    rest = vectors - mean
    norm = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(norm > 0, norm, 1)[:, None]) @ turn.T
    return np.packbits(unit >= 0, axis=1), norm, np.abs(unit).sum(1) / np.sqrt(vectors.shape[1])


def bounds(codes: np.ndarray, norm: np.ndarray, align: np.ndarray, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, a row for each query."""
    d = queries.shape[1]
    rest = queries - mean
    qn = np.linalg.norm(rest, axis=1)
    unit = ((rest / np.where(qn > 0, qn, 1)[:, None]) @ turn.T).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    safe = np.where(align > 0, align, 1)
    product = (unit @ signs.T) / (np.sqrt(d) * safe)
    error = EPSILON * np.sqrt(np.maximum(0, 1 - safe**2)) / (safe * np.sqrt(max(1, d - 1)))
    base = norm**2 + (qn**2)[:, None]
    scale = 2 * norm * qn[:, None]
    slack = 1e-5 * base
    return base - scale * np.minimum(1, product + error) - slack, base - scale * np.maximum(-1, product - error) + slack


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, components added in order."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1])


def means(df: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector for each dimension there is."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, rows, matrix in by_dimension(batch.column(0), batch.column(1)):
                n, total = sums.get(d, (0, np.zeros(d)))
                sums[d] = n + len(rows), total + matrix.sum(0)
        for d, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n), pa.int64()), pa.array(total)], names=["d", "i", "n", "s"])

    rows = df.mapInArrow(add, "d int, i int, n long, s double").groupBy("d", "i").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
    out = {r.d: np.zeros(r.d) for r in rows}
    for r in rows:
        out[r.d][r.i] = r.m
    return out


def index(df: DataFrame, mean: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of at most BLOCK vectors of one dimension: ids, vectors, packed codes and correction scalars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for d, rows, matrix in by_dimension(batch.column(0), batch.column(1)):
                turn = turns.setdefault(d, rotation(d))
                for lo in range(0, len(rows), BLOCK):
                    part = matrix[lo : lo + BLOCK]
                    codes, norm, align = encode(part, mean[d], turn)
                    blobs = (ids[rows[lo : lo + BLOCK]], part, codes, norm, align)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs)], names=["d", "ids", "vectors", "codes", "norm", "align"])

    return df.mapInArrow(run, "d int, ids binary, vectors binary, codes binary, norm binary, align binary")


def _query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """(qb, d, qids, qvectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for qb, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((qb, len(v)), []).append((i, v))
        for (qb, d), rows in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([qb], pa.int32()), pa.array([d], pa.int32()), pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([np.array([r[1] for r in rows]).tobytes()], pa.binary())],
                names=["qb", "d", "qids", "qvectors"],
            )

    keyed = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("qb"), "vec_id", "embedding")
    return keyed.repartition("qb").mapInArrow(run, "qb int, d int, qids binary, qvectors binary")


class Best:
    """The k nearest so far of a block of queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.ids, self.distance = k, np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        n, k = self.ids.shape
        rows = np.concatenate([np.repeat(np.arange(n), k), row])
        ids = np.concatenate([self.ids.ravel(), ids])
        distance = np.concatenate([self.distance.ravel(), distance])
        order = np.lexsort((ids, distance, rows))
        rows, ids, distance = rows[order], ids[order], distance[order]
        first = np.searchsorted(rows, np.arange(n))
        take = first[:, None] + np.arange(k)
        self.ids, self.distance = ids[take], distance[take]


def search(df: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `df` to each query, not counting rows with the query's id.

    Both have vec_id and embedding.
    """
    df = one_row_each(df, "vec_id", "embedding").where(usable("embedding"))
    queries = cut(one_row_each(queries, "vec_id", "embedding").where(usable("embedding")))
    n = queries.count()
    blocks = max(1, -(-n // (QUERIES * 3 // 4)))  # by hash, so of about three quarters of QUERIES
    mean = df.sparkSession.sparkContext.broadcast(means(df))
    asked = cut(_query_blocks(queries, blocks))
    data = index(df, mean.value)
    if blocks <= FEW:
        met = data.join(F.broadcast(asked), "d")
    else:
        salts = 64
        spread = data.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = spread.join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["qb", "d", "salt"])
    met = met.select("d", "qb", "qids", "qvectors", "ids", "vectors", "codes", "norm", "align")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        state: dict[tuple, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                d, qb = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                blob = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.int64), (3, np.float64), (4, np.int64), (5, np.float64), (6, np.uint8), (7, np.float64), (8, np.float64))]
                qids, q, ids, x, codes, norm, align = blob
                q, x, codes = q.reshape(-1, d), x.reshape(-1, d), codes.reshape(len(ids), -1)
                turn = turns.setdefault(d, rotation(d))
                _, best = state.setdefault((d, qb), (qids.copy(), Best(len(qids), k)))
                low, high = bounds(codes, norm, align, q, mean.value[d], turn)
                own = qids[:, None] == ids
                low[own], high[own] = np.inf, np.inf
                limit = best.distance[:, -1] ** 2 * (1 + 1e-9)
                if high.shape[1] >= k:
                    limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                row, column = np.nonzero((low <= limit[:, None]) & ~own)
                for lo in range(0, len(row), 1 << 16):
                    r, c = row[lo : lo + (1 << 16)], column[lo : lo + (1 << 16)]
                    best.add(r, ids[c], exact(x[c], q[r]))
        for qids, best in state.values():
            found = np.isfinite(best.distance)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, found.sum(1))), pa.array(best.ids[found]), pa.array(best.distance[found])], names=["query_id", "vec_id", "score"])

    near = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
