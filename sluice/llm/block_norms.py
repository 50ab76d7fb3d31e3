"""Centroid clustering with block-norm screening, exact in integers.

Vectors become integers. Each is compressed once to two numbers per block of eight
components: the block's sum over the root of its width, and the norm of what is left
beside that mean. By Cauchy and Schwarz no block of two vectors is nearer than these
two numbers are, so the squared distance of two compressed vectors is a lower bound
of the squared distance of the vectors. A vector's first exact distance is to the
centroid with the smallest bound; another centroid gets one only if its bound, less a
margin for rounding, is not above the best distance so far. All exact distances are
64-bit integers, and ties take the smaller number.

Quantised vectors and their compressed form are a written table; a round reads it,
adds up each cluster inside each task, and sums the tasks' rows in a shuffle of one
row per task, cluster and component. The driver holds the centroids alone.

Defined cases: null vectors, those of another size, and those with a null, NaN or
infinite component are left out; fewer vectors than ``k`` make fewer centroids; an
empty centroid keeps its place; repeated rows count as often as they come, and those
of one id start in order of their components; a null id hashes as an empty one; an
empty table has no clusters; components beyond 2**27 after scaling are refused, as
their distances would not fit; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMS, K, ROUNDS, SCALE, BLOCK, SEED = 64, 16, 3, 64, 8, 1
LARGEST = 1 << 27


def compressed(vectors: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Two numbers for each block of components: its mean part and the norm of the rest."""
    parts = vectors.reshape(len(vectors), -1, block).astype(np.float64)
    mean = parts.sum(2) / np.sqrt(block)
    rest = np.sqrt(np.maximum((parts**2).sum(2) - mean**2, 0))
    return np.concatenate([mean, rest], 1)


def nearest(vectors: np.ndarray, short: np.ndarray, centroids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the squared distance, and how many exact distances that took."""
    them = compressed(centroids, block)
    own, other = (short**2).sum(1), (them**2).sum(1)
    # Rounding stays far below a billionth of the norms.
    least = own[:, None] + other[None, :] - 2 * short @ them.T - 1e-9 * (own[:, None] + other[None, :]) - 1e-3
    who = least.argmin(1)
    gap = vectors - centroids[who]
    best, taken = np.einsum("ij,ij->i", gap, gap), len(vectors)
    first = who.copy()
    for j in range(len(centroids)):
        rows = np.flatnonzero((least[:, j] <= best) & (first != j))
        gap = vectors[rows] - centroids[j]
        far = np.einsum("ij,ij->i", gap, gap)
        taken += len(rows)
        won = (far < best[rows]) | ((far == best[rows]) & (j < who[rows]))
        best[rows[won]], who[rows[won]] = far[won], j
    return who, best, taken


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _shortener(dims: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = compressed(_matrix(batch.column("q"), np.int64, dims), block)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(short) + 1, dtype=np.int32) * short.shape[1]), pa.array(short.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "short"])

    return run


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """A written table of the sound vectors: vec_id, q (integers), short (their compressed form)."""
    x, out = F.col("embedding"), lambda v: F.raise_error(F.lit(f"a vector's component is beyond {LARGEST} after scaling"))
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v.cast("double") * scale) <= LARGEST, F.floor(v.cast("double") * scale).cast("int")).otherwise(out(v)))
    kind = dict(vectors.dtypes)["vec_id"]
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("q"))
    return cut(rows.mapInArrow(_shortener(dims, block), f"vec_id {kind}, q array<int>, short array<double>"), "quantised")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id (k rows reach the driver)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def _adder(centroids: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q = _matrix(batch.column("q"), np.int64, dims)
            who, _, _ = nearest(q, _matrix(batch.column("short"), np.float64, 2 * dims // block), centroids, block)
            for j in np.unique(who):
                sums[j] += q[who == j].sum(0)
            count += np.bincount(who, minlength=k)
        some = np.flatnonzero(count)
        told = [pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(count[some], dims))]
        yield pa.RecordBatch.from_arrays(told, ["cluster", "dim", "total", "n"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Centroids after one round: the floored means of their vectors (k times dims rows reach the driver)."""
    parts = vectors.select("q", "short").mapInArrow(_adder(centroids, block), "cluster int, dim int, total long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(exact("total"), exact("n")).collect():
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def _assigner(centroids: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = centroids.shape[1]
        for batch in batches:
            who, far, _ = nearest(_matrix(batch.column("q"), np.int64, dims), _matrix(batch.column("short"), np.float64, 2 * dims // block), centroids, block)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every sound vector, and the final centroids."""
    if dims % block:
        raise ValueError("blocks must divide the components evenly")
    spark = vectors.sparkSession
    table = quantised(vectors, dims, scale, block)
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        kind = dict(vectors.dtypes)["vec_id"]
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), centroids.reshape(0, dims)
    for _ in range(rounds):
        centroids = moved(table, centroids, block)
    kind = dict(table.dtypes)["vec_id"]
    found = cut(table.mapInArrow(_assigner(centroids, block), f"vec_id {kind}, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per centroid
    inertia, name = sum(r["cluster_inertia"] for r in sums), lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, name(centroids[r["cluster"]])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
