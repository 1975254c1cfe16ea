"""Partitions of vectors by a two-level tree of centres, grown until each part fits.

The first level has at most CELLS centres, which the driver holds; the parts of a cell are one row of
a table, and only tasks read them. So a vector is compared with the cells and the parts of its nearest
cells, not with every part, and no step brings all centres to one place.

fit() grows the parts of each cell in that cell's task: 1, 3, 5, 7, ... (in larger steps where there
are many) until the sizes estimated from the cell's sample fit. Then the whole sample goes through the
tree as the table will, copies of other cells' vectors included, and cells with a part that is still
too large grow on. Equal vectors cannot be told apart by centres: bounded() deals what is left over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written
from . import pq

#: Centres of the first level, at most.
CELLS = 1024
#: Parts up to which one cell is enough.
FLAT = 64
#: Sample vectors for each part, and for one cell's task at most about.
PER_PART, CELL_SAMPLE = 64, 32_768
#: Vectors of a cell that travel to its parts as one row; cells that a vector looks into.
BLOCK, PROBE = 256, 4
#: How often cells with too large parts grow on.
ATTEMPTS = 6
_PARTS = "cell int, numbers array<int>, centres array<float>, stuck boolean"


@dataclass
class Tree:
    """cells: (n, dims); parts(cell, numbers, centres): a row a cell, its centres one after another."""

    cells: np.ndarray
    parts: DataFrame


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest entries of each row, ties by column, in that order."""
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def _luck(seed: int):
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(1 << 53)


def grow(x: np.ndarray, weight: float, cap: float, copies: int = 2, seed: int = 0) -> tuple[np.ndarray, bool]:
    """(centres of few parts, 1, 3, 5, ..., of which none is estimated above cap; whether one still is).

    Each row of the sample x stands for `weight` vectors, each vector goes to its `copies` nearest
    parts. Numbers of parts whose average is above cap are passed over. Then the largest part (of many,
    the largest sixteenth) is cut in three, which adds two, and all centres move to their means. A part
    of equal rows cannot be cut; growing ends where only such are left, or at four times the parts
    that would do on average.
    """
    if len(x) * weight <= cap:
        return x.mean(0, keepdims=True), False
    least = max(3, math.ceil(len(x) * weight * copies / cap) | 1)
    centres = pq.kmeans(x, min(least, len(np.unique(x, axis=0))), 6, seed)
    while True:
        near = _nearest(_squared(x, centres), copies)
        sizes = np.bincount(near.ravel(), minlength=len(centres))
        large = [p for p in np.argsort(-sizes, kind="stable") if sizes[p] * weight > cap]
        cut = []
        for p in large:
            own = x[(near == p).any(1)]
            if len(cut) < max(1, len(centres) // 16) and (own != own[0]).any():
                cut.append((p, pq.kmeans(own, min(3, len(np.unique(own, axis=0))), 4, seed + len(centres))))
        if not cut or len(centres) > 4 * least:
            return centres[sizes > 0], len(large) > 0
        centres = np.concatenate([np.delete(centres, [p for p, _ in cut], axis=0), *[c for _, c in cut]])
        for _ in range(2):
            own = _squared(x, centres).argmin(1)
            n = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)


def cells_of(rows: DataFrame, cells: np.ndarray) -> DataFrame:
    """rows(id, vec) with the number of the nearest cell."""
    dims = cells.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _squared(_rows(batch.column(1), dims), cells).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], ["id", "vec", "cell"])

    return rows.select("id", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(run, "id bigint, vec array<float>, cell int")


def nearest_parts(rows: DataFrame, tree: Tree, m: int, probe: int = PROBE) -> DataFrame:
    """(id, part, rank, distance) of the m nearest parts of each of rows(id, vec), in squared L2.

    Rows travel in blocks of those with a cell in common, so each block meets its cell's centres once.
    Catalyst broadcasts the centres where they are few and shuffles them otherwise.
    """
    cells, dims = tree.cells, tree.cells.shape[1]
    probe = min(probe, len(cells))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        counts: dict[int, int] = {}

        def block(cell: int) -> pa.RecordBatch:
            parts = waiting.pop(cell)
            counts[cell] = 0
            ids, vecs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([vecs.ravel()], pa.list_(pa.float32()))], ["cell", "ids", "vecs"])

        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ids, x = part.column(0).to_numpy(), _rows(part.column(1), dims)
                near = _nearest(_squared(x, cells), probe).ravel()
                order = np.argsort(near, kind="stable")
                own, first = np.unique(near[order], return_index=True)
                for cell, at in zip(own.tolist(), np.split(order // probe, first[1:])):
                    for b in range(0, len(at), BLOCK):
                        some = at[b : b + BLOCK]
                        waiting.setdefault(cell, []).append((ids[some], x[some].astype(np.float32)))
                        counts[cell] = counts.get(cell, 0) + len(some)
                        if counts[cell] >= BLOCK:
                            yield block(cell)
        for cell in sorted(waiting):
            yield block(cell)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vecs, numbers, centres = (batch.column(c).slice(i, 1).flatten() for c in range(4))
                centres = centres.to_numpy().astype(np.float64).reshape(-1, dims)
                d = _squared(vecs.to_numpy().astype(np.float64).reshape(-1, dims), centres)
                near = _nearest(d, m)
                k = near.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(), k)), pa.array(numbers.to_numpy()[near.ravel()]), pa.array(np.take_along_axis(d, near, 1).ravel())], ["id", "part", "distance"])

    blocks = rows.select("id", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(deal, "cell int, ids array<bigint>, vecs array<float>")
    met = blocks.join(tree.parts, "cell").select("ids", "vecs", "numbers", "centres").mapInArrow(choose, "id bigint, part int, distance double")
    order = Window.partitionBy("id").orderBy("distance", "part")
    return met.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= m).select("id", "part", "rank", "distance")


def tree_of(centres: DataFrame, seed: int = 0) -> Tree:
    """A tree over a table of centres(id, vec), which keep their numbers."""
    n = centres.count()
    cells = 1 if n <= FLAT else min(CELLS, math.ceil(math.sqrt(n)))
    cells = pq.kmeans(pq.sample(centres, max(1000, 50 * cells), seed), cells, 6, seed)

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        return pa.table([table.column("cell")[:1], pa.array([table.column("id").to_numpy().astype(np.int32)], pa.list_(pa.int32())), pa.array([table.column("vec").combine_chunks().flatten()], pa.list_(pa.float32())), pa.array([False])], names=["cell", "numbers", "centres", "stuck"])

    dealt = written(cells_of(centres, cells))
    cells, dealt = _present(cells, dealt)
    return Tree(cells, written(dealt.groupBy("cell").applyInArrow(pack, _PARTS)))


def _present(cells: np.ndarray, dealt: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Cells that have rows of dealt, numbered anew."""
    some = sorted(r.cell for r in dealt.select("cell").distinct().collect())  # CELLS rows at most
    if len(some) == len(cells):
        return cells, dealt
    names = F.create_map(*[F.lit(x) for i, c in enumerate(some) for x in (c, i)])
    return cells[some], dealt.withColumn("cell", names[F.col("cell")].cast("int"))


def fit(vectors: DataFrame, cap: int, copies: int = 2, seed: int = 0, probe: int = PROBE) -> Tree:
    """A tree for vectors(id, vec), each in its `copies` nearest parts, whose parts are estimated to hold `cap` rows at most."""
    if cap < 1:
        raise ValueError("a part must hold a vector")
    vectors = vectors.select("id", "vec")
    n = vectors.count()
    if not n:
        raise ValueError("there are no vectors")
    want = 1 if n <= cap else math.ceil(n * copies / cap)
    cells = 1 if want <= FLAT else min(CELLS, math.ceil(math.sqrt(want)))
    coarse = pq.kmeans(pq.sample(vectors, max(1000, 50 * cells), seed), cells, 6, seed)
    rate = min(1.0, max(PER_PART * want, 2048) / n)
    part = vectors.where(_luck(seed + 1) < rate)
    coarse, dealt = _present(coarse, written(cells_of(part, coarse)))
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    keep = F.create_map(*[F.lit(x) for c, k in counts.items() for x in (c, CELL_SAMPLE / k)])
    thin = dealt.where(_luck(seed + 2) < keep[F.col("cell")])
    caps = dict.fromkeys(counts, float(cap))
    for attempt in range(ATTEMPTS):
        tree = Tree(coarse, _numbered(written(thin.groupBy("cell").applyInArrow(_grower(dict(caps), counts, rate, copies, seed), _PARTS))))
        if sum(counts.values()) <= rate * cap and len(coarse) == 1:
            return tree
        sizes = nearest_parts(part, tree, copies, probe).groupBy("part").count()
        where = tree.parts.select("cell", F.explode("numbers").alias("part"))
        worst = {r["cell"]: r.worst / rate for r in sizes.join(where, "part").groupBy("cell").agg(F.max("count").alias("worst")).collect()}
        stuck = {r.cell for r in tree.parts.where("stuck").select("cell").collect()}
        over = {c: w for c, w in worst.items() if w > cap and c not in stuck}
        if not over or attempt == ATTEMPTS - 1:
            return tree
        for c, w in over.items():
            caps[c] *= max(0.5, 0.95 * cap / w)


def _grower(caps: dict, counts: dict, rate: float, copies: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        cell = table.column("cell")[0].as_py()
        vec = table.column("vec").combine_chunks()
        x = vec.flatten().to_numpy().astype(np.float64).reshape(len(vec), -1)
        centres, stuck = grow(x, counts[cell] / rate / len(x), caps[cell], copies, seed)
        return pa.table([pa.array([cell], pa.int32()), pa.array([np.arange(len(centres))], pa.list_(pa.int32())), pa.array([centres.ravel().astype(np.float32)], pa.list_(pa.float32())), pa.array([stuck])], names=["cell", "numbers", "centres", "stuck"])

    return run


def _numbered(parts: DataFrame) -> DataFrame:
    """parts with numbers that go on from cell to cell."""
    sizes = sorted((r.cell, r.n) for r in parts.select("cell", F.size("numbers").alias("n")).collect())  # CELLS rows at most
    first = np.cumsum([0] + [n for _, n in sizes]).tolist()
    names = F.create_map(*[F.lit(x) for (c, _), a in zip(sizes, first) for x in (c, a)])
    return parts.withColumn("numbers", F.transform("numbers", lambda i: (i + names[F.col("cell")]).cast("int")))


def bounded(rows: DataFrame, cap: int, by: str = "shard") -> DataFrame:
    """rows(by, id, ...) with groups beyond cap dealt into even parts by a hash of the id; new numbers follow the old ones.

    Numbers are computed from a row a group: group g becomes g + groups * part.
    """
    n = F.count(F.lit(1))
    sizes = rows.groupBy(by).agg(n.alias("n"))
    groups = sizes.agg(F.max(by).alias("most"))
    sizes = sizes.select(by, F.when(F.col("n") <= cap, 1).otherwise(F.ceil(F.col("n") / (0.8 * cap))).cast("int").alias("parts"))  # hashing is not quite even
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return rows.join(sizes, by).join(F.broadcast(groups)).withColumn(by, (F.col(by) + (F.col("most") + 1) * part).cast("int")).drop("parts", "most")
