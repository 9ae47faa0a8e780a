"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector is centred, normalised and rotated by a seeded orthogonal matrix; the signs are its code, packed to bits,
and two scalars are kept: its norm and its inner product with its own code vector. With them, the packed bits give an
unbiased estimate of an inner product and a bound of its error. A block of codes is estimated against a block of
queries; the best by estimate are scored, the k-th of them sets the bar, and only vectors whose upper bound reaches it are
reranked on the original vectors. Every vector is indexed; the matrix and the centre (the mean of all vectors) are all that is
fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise

NEAREST, EVERY, SEED = 20, 20, 17
#: Half-width of the error bound in standard deviations; at 3 the bound fails about once in 400 pairs.
BOUND = 3.0
#: Vectors in a block of codes, and queries in a block.
BLOCK, QUERY_BLOCK = 8192, 2048


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, uniformly distributed, the same on every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, norms of the centred vectors, correction scalars, inner products with the centre)."""
    from_centre = vectors - centre
    norm = np.sqrt((from_centre**2).sum(1))
    turned = from_centre @ turn.T / np.where(norm > 0, norm, 1)[:, None]
    bits = turned > 0
    own = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(bits, axis=1), norm, np.where(own > 0, own, 1.0), vectors @ centre


def estimate(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, with_centre: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, half-widths of their error bounds) of the inner products of queries (rows) with coded vectors (columns).

    <x, q> = <x - c, q - c> + <x, c> + <q - c, c>; the first term is estimated from the bits.
    """
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    q = queries - centre
    length = np.sqrt((q**2).sum(1))
    # the scale of a vector goes into its signs, so that one product gives the estimates
    signs *= (norm / own / np.sqrt(dim)).astype(np.float32)[:, None]
    est = (q @ turn.T).astype(np.float32) @ signs.T
    est += with_centre.astype(np.float32)[None, :]
    est += (q @ centre).astype(np.float32)[:, None]
    wide = bound * norm * np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(max(1, dim - 1)) + 1e-5 * norm
    err = length.astype(np.float32)[:, None] * wide.astype(np.float32)[None, :]
    err += np.float32(1e-5 * (1 + np.abs(with_centre).max(initial=0)))
    return est, err


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, every component finite, and of the commonest length."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (dim[0].d if dim else 0))


def _index(rows: DataFrame, centre: np.ndarray, seed: int) -> DataFrame:
    """Blocks of vectors with their codes: ids, codes, scalars and originals, one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(len(centre), seed)
        for b in batches:
            ids, v = b.column(0).to_numpy(), _matrix(b.column(1))
            for i in range(0, len(ids), BLOCK):
                part = v[i : i + BLOCK]
                code, norm, own, mid = encode(part, centre, turn)
                blobs = [ids[i : i + BLOCK].tobytes(), code.tobytes(), np.stack([norm, own, mid]).tobytes(), part.tobytes()]
                yield pa.record_batch([pa.array([x], pa.binary()) for x in blobs], names=["ids", "codes", "scalars", "vectors"])

    return rows.mapInArrow(run, "ids binary, codes binary, scalars binary, vectors binary")


def _queries(rows: DataFrame) -> DataFrame:
    """Blocks of queries: one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0).to_numpy(), _matrix(b.column(1))
            for i in range(0, len(ids), QUERY_BLOCK):
                yield pa.record_batch([pa.array([ids[i : i + QUERY_BLOCK].tobytes()], pa.binary()), pa.array([v[i : i + QUERY_BLOCK].tobytes()], pa.binary())], names=["qids", "qvectors"])

    return rows.mapInArrow(run, "qids binary, qvectors binary")


def search_block(ids: np.ndarray, vectors: np.ndarray, est: np.ndarray, err: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k nearest of each query in a block, after reranking by the bounds.

    The best by estimate are scored first; the k-th of these scores is the bar that an upper bound must reach.
    """

    def exact(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        score = np.empty(len(row))
        for i in range(0, len(row), 20_000):
            s = slice(i, i + 20_000)
            # summed in the order of the components, so that equal vectors have equal scores wherever they are
            score[s] = np.cumsum(queries[row[s]] * vectors[col[s]], axis=1)[:, -1]
        return score

    n, m = len(ids), len(qids)
    bar = np.full(m, -np.inf)
    first = min(n, 2 * k + 1)
    if n > first:
        head = np.argpartition(est, n - first, axis=1)[:, n - first :]
        score = exact(np.repeat(np.arange(m), first), head.ravel()).reshape(m, first)
        score[ids[head] == qids[:, None]] = -np.inf
        bar = np.partition(score, first - k, axis=1)[:, first - k]
    row, col = np.nonzero(est + err >= bar[:, None].astype(est.dtype))
    other = ids[col] != qids[row]
    row, col = row[other], col[other]
    # rerank in two steps: plain double products against the bar, then the few that reach it in the fixed order
    reach = np.empty(len(row), bool)
    for i in range(0, len(row), 20_000):
        s = slice(i, i + 20_000)
        b = bar[row[s]]
        with np.errstate(invalid="ignore"):
            reach[s] = ~(np.einsum("ij,ij->i", queries[row[s]], vectors[col[s]]) < b - 1e-9 * (1 + np.abs(b)))
    row, col = row[reach], col[reach]
    score = exact(row, col)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return qids[row[top]], ids[col[top]], score[top]


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, seed: int = SEED, bound: float = BOUND, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, its k nearest others found.

    Nearness is the inner product in double precision on the original vectors; ties go to the smaller id. Vectors that
    are null, zero, of another length than most, without id, or that hold a null or non-finite component take no part;
    a query that takes no part has no rows. Rows with one id each count; a query's candidates are rows with another id.
    Other columns are ignored; an empty table gives an empty result.

    Blocks of queries meet blocks of vectors by a join on a block number that each vector block lists, so a task holds
    one block of each; a block gives k rows a query at most.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, vector, key), "ann-vectors")
    head = rows.select(F.size("v").alias("d")).limit(1).collect()
    dim = head[0].d if head else 1
    mean = rows.agg(*(F.avg(F.col("v")[i]) for i in range(dim))).first()
    centre = np.array([x or 0.0 for x in mean])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = materialise(_queries(rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).coalesce(max(1, parts // 4))), "ann-queries")
    index = _index(rows.coalesce(max(1, parts // 4)), centre, seed)
    numbered = queries.select(F.monotonically_increasing_id().alias("b"), "qids", "qvectors")
    numbers = [r.b for r in numbered.select("b").toLocalIterator()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for b in batches:
            for i in range(b.num_rows):
                ids, codes, scalars, v, qids, q = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in enumerate((np.int64, np.uint8, np.float64, np.float64, np.int64, np.float64)))
                v, q, scalars = v.reshape(len(ids), dim), q.reshape(len(qids), dim), scalars.reshape(3, len(ids))
                codes = codes.reshape(len(ids), -1)
                for j in range(0, len(qids), 256):
                    s = slice(j, j + 256)
                    est, err = estimate(codes, *scalars, q[s], centre, turn, bound)
                    found = search_block(ids, v, est, err, qids[s], q[s], k)
                    yield pa.record_batch([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    if not numbers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = index.withColumn("b", F.explode(F.array(*(F.lit(n) for n in numbers))))
    met = asked.join(numbered.hint("shuffle_hash"), "b").select("ids", "codes", "scalars", "vectors", "qids", "qvectors")
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
