"""Nearest neighbours by randomly rotated one-bit codes.

Unit vectors are turned by one random rotation and kept as the signs of their components, packed to bits, with one
correction scalar: s = <sign vector, turned vector>.  For a turned query q, <sign vector, q> / s estimates the cosine, and
the error is at most sqrt(1 - s^2) / s times the query's part along one direction that the rotation makes random, whose
size passes EPSILON / sqrt(dim - 1) with a probability of some 1 in 30,000.  Vectors whose upper bound reaches the k-th
best exact score so far are reranked: first by single-precision products, then, where those reach that score but for
their rounding, by the original components in double precision.

The k-th best score to beat begins with that of a bounded sample of the rows, scored on the driver, so that no task starts
from nothing.  Every row is indexed, and every row is scanned: with thousands of queries at once nearly every row is a
candidate of some, so codes and vectors lie side by side and a scan reads them once for up to QUERIES queries, which the
tasks take in tiles.  The work is that of the stated queries against all rows; a task returns at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written

SEED, EPSILON = 7, 4.0
#: Queries of a scan, and the bytes that they may have; rows and queries of a tile; rows of the sample.
QUERIES, QUERY_BYTES, ROWS, TILE, SAMPLE = 1 << 16, 32 << 20, 2048, 2048, 4096
#: More than single precision can be wrong about a cosine.
ROUNDING = 1e-4


@lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so that the result has one definition."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction scalars) of the rows."""
    dim = x.shape[1]
    turned = (x / norms(x)[:, None]).astype(np.float32) @ rotation(dim).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim)


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, code binary, s float, norm double, vector as it came, if an array of float, else of double), a row for
    each row that takes part.

    Vectors that are null, empty or zero, hold null or non-finite components or have no finite norm, and rows without an id
    take no part; other columns are not read.
    """
    kind = "float" if vectors.select(F.col(vector_col)).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    fine = "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('infinity') and not isnan(x))"
    norm2 = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.where(fine).where((norm2 > 0) & (norm2 < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "dim", "code", "s", "norm", "vector"]
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                some = batch.filter(pa.array(sizes == dim))
                x = matrix(some.column(1))
                code, s = encode(x)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(s), dim, np.int32)), codes, pa.array(s, pa.float32()), pa.array(norms(x)), some.column(1)], names)

    return rows.mapInArrow(run, f"vec_id long, dim int, code binary, s float, norm double, vector array<{kind}>")


class Best:
    """The k best exact scores of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.q, self.id, self.score = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        q, id_, score = np.r_[self.q, q], np.r_[self.id, id_], np.r_[self.score, score]
        order = np.lexsort((id_, -score, q))
        q, id_, score = q[order], id_[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], id_[keep], score[keep]
        last = rank == self.k - 1
        self.least[q[last]] = score[last]


class Searcher:
    """A tile of queries of one dimension against rows of the index.  floor: a score that k rows are known to reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.x, self.norm, self.floor = ids, x, norms(x), floor
        self.unit = (x / self.norm[:, None]).astype(np.float32)
        self.turned = (self.unit @ rotation(x.shape[1]).T).T
        self.best = Best(len(ids), k)

    def least(self) -> np.ndarray:
        return np.maximum(self.floor, self.best.least)

    def rerank(self, vec_id: np.ndarray, x: np.ndarray, unit: np.ndarray, norm: np.ndarray, row: np.ndarray, q: np.ndarray) -> None:
        least = self.least()
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], q[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[r], self.unit[c]) >= least[c] - ROUNDING
            r, c = r[near], c[near]
            self.best.add(c, vec_id[r], dots(x[r].astype(np.float64), self.x[c]) / (norm[r] * self.norm[c]))

    def scan(self, vec_id: np.ndarray, signs: np.ndarray, s: np.ndarray, norm: np.ndarray, x: np.ndarray, unit: np.ndarray) -> None:
        """signs: the unpacked codes, as +1 and -1 over sqrt(dim)."""
        dim = x.shape[1]
        estimate = (signs @ self.turned) / s[:, None]
        width = np.sqrt(np.maximum(0, 1 - s * s)) / s * min(1.0, EPSILON / np.sqrt(max(1, dim - 1))) + 1e-5
        estimate[vec_id[:, None] == self.ids[None, :]] = -np.inf
        done = np.zeros(estimate.shape, bool)
        if (new := np.flatnonzero(np.isinf(self.least()))).size:  # queries without k scores begin with their best estimates
            n = min(4 * self.best.k, len(x))
            row = np.argpartition(-estimate[:, new], n - 1, axis=0)[:n]
            done[row, new[None, :]] = True
            done &= estimate > -np.inf
            self.rerank(vec_id, x, unit, norm, *np.nonzero(done))
        row, q = np.nonzero((estimate + width[:, None].astype(np.float32) >= self.least()[None, :].astype(np.float32) - np.float32(1e-6)) & ~done & (estimate > -np.inf))
        self.rerank(vec_id, x, unit, norm, row, q)


def floors(sample: tuple[np.ndarray, np.ndarray], ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k-th best cosine of each query in the sample (ids, vectors), its own id left out, less what rounding may add."""
    out = np.full(len(ids), -np.inf)
    own, rows = sample
    if len(own) > k:
        unit = (rows / norms(rows)[:, None]).astype(np.float32).T
        for at in range(0, len(ids), TILE):
            some = x[at : at + TILE]
            score = (some / norms(some)[:, None]).astype(np.float32) @ unit
            score[ids[at : at + TILE][:, None] == own[None, :]] = -np.inf
            out[at : at + TILE] = np.partition(score, len(own) - k, axis=1)[:, len(own) - k] - ROUNDING
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest of each row of `queries` (rows of an index) by cosine among
    the rows of `index` with another id and the same dimension; ties go to the smaller id; fewer if there are fewer.

    Repeated rows of the index are candidates of their own; repeated queries are one; no queries or no index give no rows.
    """
    spark = index.sparkSession
    queries = queries.select("vec_id", "dim", "vector").distinct()
    dims = sorted((r.dim, r["count"]) for r in queries.groupBy("dim").count().collect())
    found = None
    for dim, count in dims:
        rows = index.where(F.col("dim") == dim)
        sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, max(1, QUERY_BYTES // (8 * dim)))).toArrow()
        sample = (sample.column("vec_id").to_numpy(), matrix(sample.column("vector").combine_chunks()))
        block = max(1, min(QUERIES, QUERY_BYTES // (8 * dim)))
        blocks = -(-count // block)
        for b in range(blocks):
            own = queries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).orderBy("vec_id", "vector").toArrow()
            if not own.num_rows:
                continue
            ids, x = own.column("vec_id").to_numpy(), matrix(own.column("vector").combine_chunks())
            sent = spark.sparkContext.broadcast((ids, x, floors(sample, ids, x, k)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                ids, x, floor = sent.value
                tiles = [(at, Searcher(ids[at : at + TILE], x[at : at + TILE], floor[at : at + TILE], k)) for at in range(0, len(ids), TILE)]
                for batch in batches:
                    for at in range(0, batch.num_rows, ROWS):
                        some = batch.slice(at, ROWS)
                        code = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint8).reshape(some.num_rows, -1)
                        own, norm = some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1), some.column("norm").to_numpy()
                        unit, dim = (own / norm[:, None]).astype(np.float32), own.shape[1]
                        signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * np.float32(2 / np.sqrt(dim)) - np.float32(1 / np.sqrt(dim))
                        for _, tile in tiles:
                            tile.scan(some.column("vec_id").to_numpy(), signs, some.column("s").to_numpy(), norm, own, unit)
                for at, tile in tiles:
                    best = tile.best
                    yield pa.RecordBatch.from_arrays([pa.array(best.q + at), pa.array(tile.ids[best.q]), pa.array(best.id), pa.array(best.score)], ["q", "query_id", "vec_id", "score"])

            part = rows.select("vec_id", "code", "s", "norm", "vector").mapInArrow(run, "q long, query_id long, vec_id long, score double")
            order = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
            part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if blocks > 1 or len(dims) > 1:
                part = written(part, "ann-block")
            found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`search` over an index of all of `vectors`, with the rows whose id is divisible by `every` as queries."""
    index = written(build_index(vectors, id_col=id_col, vector_col=vector_col), "ann-index")
    return search(index, index.where(F.col("vec_id") % every == 0), k)


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), n as (
  select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) as norm from v
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_reduce(list_transform(list_zip(c.e, q.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (c.norm * q.norm) as score
  from n q join n c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0 and q.norm > 0 and c.norm > 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
) where rank <= 5
"""
