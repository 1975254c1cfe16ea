"""Product quantisation: training, codes, table distances.

A codebook is chunks of consecutive dimensions with up to 256 centres each; it has a fixed size, so
it travels to the tasks. Vectors are encoded by Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import distances

CENTRES = 256
#: Rounds of codes and rotation.
OPQ_ROUNDS = 20
#: Rows that are compared with all centres at once.
ASSIGN = 8192
#: Vectors that training reads at most, as a hash sample.
TRAIN_VECTORS = 256_000


@dataclass
class Codebook:
    """centres: per chunk (n, dims of the chunk); offsets: where chunks begin; mean: taken off first; rotation: applied then."""

    centres: list[np.ndarray]
    offsets: np.ndarray
    mean: np.ndarray | None = None
    rotation: np.ndarray | None = None

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean if self.mean is not None else x
        return x @ self.rotation if self.rotation is not None else x

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = self.prepared(x)
        return np.column_stack([distances("l2", x[:, a:b], c).argmin(1) for c, a, b in zip(self.centres, self.offsets, self.offsets[1:])]).astype(np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        x = np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centres)], axis=1)
        x = x @ self.rotation.T if self.rotation is not None else x
        return x + self.mean if self.mean is not None else x

    def tables(self, queries: np.ndarray, metric: str = "l2") -> list[np.ndarray]:
        """Per chunk (queries, centres): squared distances, or negative products."""
        q = self.prepared(queries) if metric == "l2" else (queries @ self.rotation if self.rotation is not None else queries)
        return [distances(metric, q[:, a:b], c) for c, a, b in zip(self.centres, self.offsets, self.offsets[1:])]


def chunk_offsets(dim: int, chunks: int) -> np.ndarray:
    """Chunks whose sizes differ by one at most, larger ones first."""
    if not 0 < chunks <= dim:
        raise ValueError("chunks must be between 1 and the dimension")
    sizes = [dim // chunks + (i < dim % chunks) for i in range(chunks)]
    return np.concatenate([[0], np.cumsum(sizes)])


def chunks_for_budget(budget_bytes: int, n: int, dim: int, most: int = 512) -> int:
    """Bytes of code a vector that a memory budget allows."""
    return max(1, min(budget_bytes // max(1, n), dim, most))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from k-means++ seeds; an empty cluster becomes the zero vector; stops when the residual hardly falls."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = np.empty((k, x.shape[1]))
    centres[0] = x[rng.integers(len(x))]
    near = ((x - centres[0]) ** 2).sum(1)
    for i in range(1, k):
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        centres[i] = x[pick]
        near = np.minimum(near, ((x - centres[i]) ** 2).sum(1))
    before = np.inf
    for _ in range(rounds):
        own, residual = np.empty(len(x), np.int64), 0.0
        for a in range(0, len(x), ASSIGN):
            part = x[a : a + ASSIGN]
            d = (part * part).sum(1)[:, None] - 2 * part @ centres.T + (centres * centres).sum(1)
            own[a : a + ASSIGN] = d.argmin(1)
            residual += float(np.maximum(0, d.min(1)).sum())
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], 0.0)
        if residual < 1e-9 or (before - residual) / max(before, 1e-30) < 1e-5 and np.isfinite(before):
            break
        before = residual
    return centres


def kmeans_distributed(vectors: DataFrame, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means over all rows: seeds from a hash sample, rounds as partial sums in tasks and one sum a centre."""
    centres = kmeans(sample(vectors, max(10_000, 50 * k), seed), k, 4, seed)
    dim = centres.shape[1]
    for _ in range(rounds):

        def part(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                x = _rows(batch.column(0), dim)
                own = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
                np.add.at(sums, own, x)
                n += np.bincount(own, minlength=len(centres))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], ["c", "n", "sums"])

        got = vectors.select("vec").mapInArrow(part, "c bigint, n bigint, sums array<double>").select("c", "n", F.posexplode("sums").alias("d", "x"))
        got = got.groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # k rows a dimension
        new = np.zeros_like(centres)
        for r in got:
            new[r.c, r.d] = r.x / r.n
        if np.abs(new - centres).max() < 1e-7:
            return new
        centres = new
    return centres


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dim)


def sampled(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n of vectors(id, vec), chosen by a hash of the id."""
    total = max(1, vectors.count())
    luck = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(1 << 53)
    return vectors.where(luck <= min(1.0, n / total)).select("id", "vec")


def sample(vectors: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """About n vectors, chosen by a hash of the id, on the driver."""
    rows = sampled(vectors, n, seed).toPandas().sort_values("id")
    return np.array([np.asarray(v, np.float64) for v in rows["vec"]])


def train(vectors: DataFrame, chunks: int, centres: int = CENTRES, metric: str = "l2", opq: bool = False, seed: int = 0, n: int = TRAIN_VECTORS) -> Codebook:
    """A codebook from about n vectors; the mean is taken off unless metric is ip or opq is set.

    Each chunk is learned by a task of its own from the sample's components of that chunk. With opq
    the sample comes to the driver, as each round needs all of it for the rotation.
    """
    if not 0 < centres <= CENTRES:
        raise ValueError(f"centres must be between 1 and {CENTRES}")
    first = vectors.select(F.size("vec").alias("d")).first()
    if first is None:
        raise ValueError("no vectors to train on")
    offsets = chunk_offsets(first.d, chunks)
    if opq:
        return _train_rotated(sample(vectors, n, seed), offsets, centres, seed)
    centred = metric != "ip"

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        i = table.column("chunk")[0].as_py()
        x = _rows(table.column("part").combine_chunks(), int(offsets[i + 1] - offsets[i]))
        mean = x.mean(0) if centred else np.zeros(x.shape[1])
        own = kmeans(x - mean, centres, seed=seed + i)
        k = len(own)
        return pa.table([pa.array([i] * k, pa.int32()), pa.array(np.arange(k, dtype=np.int32)), pa.array(list(own), pa.list_(pa.float64())), pa.array([mean] * k, pa.list_(pa.float64()))], names=["chunk", "centre", "vec", "mean"])

    vec = F.col("vec").cast("array<double>")
    parts = F.array(*[F.struct(F.lit(i).alias("chunk"), F.slice(vec, int(a) + 1, int(b - a)).alias("part")) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))])
    rows = sampled(vectors, n, seed).select("id", F.explode(parts).alias("p")).select("id", "p.chunk", "p.part")
    found = rows.groupBy("chunk").applyInArrow(fit, "chunk int, centre int, vec array<double>, mean array<double>").collect()  # a byte's centres a chunk
    if not found:
        raise ValueError("no vectors to train on")
    found.sort(key=lambda r: (r.chunk, r.centre))
    own = [np.array([r.vec for r in found if r.chunk == i]) for i in range(chunks)]
    mean = np.concatenate([next(np.array(r.mean) for r in found if r.chunk == i) for i in range(chunks)])
    return Codebook(own, offsets, mean if centred else None)


def _train_rotated(x: np.ndarray, offsets: np.ndarray, centres: int, seed: int) -> Codebook:
    fit = lambda y: [kmeans(y[:, a:b], centres, seed=seed + i) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(OPQ_ROUNDS):  # codes for the rotation, then the rotation for the codes
        book = Codebook(fit(x @ rotation), offsets)
        u, _, v = np.linalg.svd(x.T @ book.decode(book.encode(x @ rotation)))
        rotation = u @ v
    return Codebook(fit(x @ rotation), offsets, None, rotation)


def fixed_codebook(rows: DataFrame, chunks: int) -> Codebook:
    """A codebook whose centres are the chunks of given vectors(id, vec), in order of id."""
    x = np.array([list(map(float, r.vec)) for r in rows.orderBy("id").limit(CENTRES + 1).collect()])
    if len(x) > CENTRES:
        raise ValueError(f"a code of one byte tells {CENTRES} centres apart, not more")
    offsets = chunk_offsets(x.shape[1], chunks)
    return Codebook([x[:, a:b] for a, b in zip(offsets, offsets[1:])], offsets)


def encode(vectors: DataFrame, book: Codebook) -> DataFrame:
    """(id, code): the nearest centre of each chunk, the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = book.encode(_rows(batch.column(1), int(book.offsets[-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(codes), pa.list_(pa.int16()))], ["id", "code"])

    return vectors.select("id", "vec").mapInArrow(run, "id bigint, code array<smallint>")


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(book.decode(c)), pa.list_(pa.float64()))], ["id", "vec"])

    return codes.select("id", "code").mapInArrow(run, "id bigint, vec array<double>")


def table_distances(codes: DataFrame, queries: DataFrame, book: Codebook, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest codes by summed table entries; queries in blocks, each a pass over the codes."""
    from .knn import _blocks, ranked

    schema = "query_id bigint, id bigint, distance double"
    out = None
    for block in _blocks(queries, ["query_id", "vec"]):
        ids = np.array(block["query_id"], np.int64)
        tables = book.tables(np.array([list(map(float, v)) for v in block["vec"]]), metric)
        part = codes.select("id", "code").mapInArrow(_table_scanner(ids, tables, k), schema)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else codes.sparkSession.createDataFrame([], schema)
    return ranked(out, k).select("query_id", "rank", "id", "distance")


def _table_scanner(ids: np.ndarray, tables: list[np.ndarray], k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = part.column(0).to_numpy(zero_copy_only=False)
                c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                for a in range(0, len(ids), 256):
                    some = ids[a : a + 256]
                    d = np.zeros((len(some), len(own)))
                    for i, t in enumerate(tables):
                        d += t[a : a + 256, c[:, i]]
                    keep = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.ones(d.shape, bool)
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(some[i]), pa.array(own[j]), pa.array(d[i, j])], ["query_id", "id", "distance"])

    return scan
