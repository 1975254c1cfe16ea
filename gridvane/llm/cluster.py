"""Centroid clustering (k-means on integers) with a float32 screen and exact decisions.

A vector's distances to all centroids come from one float32 matrix product. Each is known within an
interval: a product of d terms, summed in any order, is off by at most g |x| |c| with
g = (d + 2) u / (1 - (d + 2) u) and u = 2**-24 (two more roundings where an integer is not a float32).
A centroid whose interval lies above another's is out. Where more than one is left, the distances are
computed anew in 64-bit integers, and the smallest number of the nearest wins. So the result is that
of exact arithmetic, whatever the order of summation or the number of tasks.

Each task sums its vectors by cluster and sends k rows, however many vectors or copies of one it has;
sums and counts are integers, and the mean is rounded down exactly. The driver has k centroids.

Kept are vectors of exactly `dims` components, none null or not finite; others are left out, as are
null vectors. Repeated rows and equal vectors count each; a null id is kept and hashed as one without
digits. With fewer than k kept vectors there are as many centroids; an empty table gives no rows.
Ties at the start (equal hashes) go to the smaller vector. Columns beyond id and vector are dropped,
whatever their names. A scaled component beyond 2**27 is refused with an error, as its squared
distance would not fit a 64-bit integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Largest size of an integer component: 64 squares of differences stay below 2**63.
LARGEST = 1 << 27
#: Vectors that are compared at once.
BLOCK = 4096
_U = 2.0**-24


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v) of the kept vectors: v is floor(scale * x) of each component."""
    x = F.col(vec_col).cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = lambda e: F.floor(F.when(F.abs(e) * scale <= LARGEST, e * scale).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("double"))).cast("int")
    return vectors.where(x.isNotNull() & good).select(F.col(id_col).alias("id"), F.transform(x, scaled).alias("v"))


def first_centroids(points: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = points.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def screened(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) booleans: which centroids may be the nearest, by float32 products and their error bounds."""
    d = x.shape[1]
    g = (d + 2) * _U / (1 - (d + 2) * _U)
    c2 = (centroids * centroids).sum(1).astype(np.float64)
    dots = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    score = c2 - 2 * dots  # the squared distance without the part that all centroids share
    size = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(c2)[None, :]
    # the second part covers the roundings of this line and of the norms, in double
    off = 2 * g * size * (1 + 2.0**-40) + 2.0**-48 * (c2 + 2 * size)
    return score - off <= (score + off).min(1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each integer vector's nearest centroid, exactly; the smallest number of equals."""
    possible = screened(x, centroids)
    who = possible.argmax(1)
    rows = np.flatnonzero(possible.sum(1) > 1)
    if len(rows):
        i, j = np.nonzero(possible[rows])
        exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        for a in range(0, len(i), BLOCK):
            gap = x[rows[i[a : a + BLOCK]]] - centroids[j[a : a + BLOCK]]
            exact[i[a : a + BLOCK], j[a : a + BLOCK]] = (gap * gap).sum(1)
        who[rows] = exact.argmin(1)
    gap = x - centroids[who]
    return who, (gap * gap).sum(1)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    kind, dims = points.schema["id"].dataType.simpleString(), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dims):
            who, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(who.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return points.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each cluster's mean; an empty one stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, dims):
            who, _ = nearest(x, centroids)
            order = np.argsort(who, kind="stable")
            own, first = np.unique(who[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(who, minlength=k)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = points.mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # k rows
        out[r.cluster] = [t // r.n for t in r.total]
    return out


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every kept vector, the final centroids).

    The integer vectors are written once and read in each round.
    """
    points = written(integers(vectors, id_col, vec_col, dims, scale))
    centroids = first_centroids(points, k, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(points, centroids)
    found = _assigned(points, centroids).withColumnRenamed("id", id_col)
    return found, centroids


def digests(centroids: np.ndarray) -> list[str]:
    """The sha256 of each centroid's components as decimal integers, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256; k rows are broadcast."""
    found = written(found)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.agg(F.sum("distance").alias("inertia"))
    names = found.sparkSession.createDataFrame(list(enumerate(digests(centroids))), "cluster int, centroid_sha256 string")
    more = sums.join(F.broadcast(names), "cluster").join(F.broadcast(total))
    return found.join(F.broadcast(more), "cluster")
