"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are projected on their leading principal directions and sorted by the cells of a grid
of width epsilon, the distance that the cosine threshold stands for. The sorted sequence of a label
is cut into blocks of bounded size. A pair of blocks is joined only if their boxes come within
epsilon; inside a pair, the two intervals are halved recursively, and intervals whose boxes are
provably farther apart are skipped. Copies of a vector are one row with a count, and a task returns
link counts and a spanning forest, so a group's pairs are never written out.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do those
without a label; each is its own component. Vectors of different lengths never link. Rows that
repeat an id are rows of their own; a null id counts as the largest. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .simhash import forest

#: Principal directions of the grid, vectors of a block, and rows below which an interval is not halved.
DIRECTIONS, BLOCK, LEAF = 6, 512, 64


def _matrix(column) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(usable, [(length, rows)] by vector length) and the values, from an Arrow list array."""
    n = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(column), pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(lengths) - lengths
    usable, by_length = np.zeros(n, bool), []
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        x = values[begin[rows][:, None] + np.arange(d)] + 0.0  # -0.0 becomes 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(x).all(1) & (norm > 0)
        usable[rows] = good
        by_length.append((int(d), rows[good], x[good]))
    return usable, by_length


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the leading principal directions of all unit vectors (one column each)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False) // 8
            for d in np.unique(sizes):
                u = _unit(np.frombuffer(b"".join(batch.column(0).filter(pa.array(sizes == d)).to_pylist()), "<f8").reshape(-1, d))
                u = np.column_stack([u, np.ones(len(u))])
                sums[int(d)] = sums.get(int(d), 0) + u.T @ u
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1)), pa.array(range(d + 1)), pa.array([r.tobytes() for r in s], pa.binary())], ["d", "r", "sums"])

    def total(table: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x, "<f8") for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"d": table.column("d")[:1], "r": table.column("r")[:1], "sums": pa.array([s.tobytes()], pa.binary())})

    got = rows.select("vec").mapInArrow(part, "d bigint, r bigint, sums binary").groupBy("d", "r").applyInArrow(total, "d bigint, r bigint, sums binary").toArrow()
    out: dict[int, dict[int, np.ndarray]] = {}
    for d, r, s in zip(*(got.column(c).to_pylist() for c in ("d", "r", "sums"))):
        out.setdefault(d, {})[r] = np.frombuffer(s, "<f8")
    axes = {}
    for d, by in out.items():
        m = np.array([by[i] for i in range(d + 1)])
        mean = m[d, :d] / m[d, d]
        _, v = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
        axes[d] = v[:, ::-1][:, :DIRECTIONS]
    return axes


def _apart(a: np.ndarray, b: np.ndarray, reach: float) -> bool:
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > reach * reach


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, least: float, reach: float, a: int = 0, b: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors x and y with dot >= least; px, py: their projections, in grid order."""
    if _apart(px, py, reach):
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        dots = x @ y.T
        hit = dots >= least
        for i, j in zip(*np.nonzero(np.abs(dots - least) < 1e-9)):  # so close, the order of sums decides: take the plain one
            hit[i, j] = float((x[i] * y[j]).sum()) / (float(np.sqrt((x[i] ** 2).sum())) * float(np.sqrt((y[j] ** 2).sum()))) >= least
        i, j = np.nonzero(hit)
        yield i + a, j + b
    elif len(x) >= len(y):
        h = len(x) // 2
        yield from join_intervals(x[:h], px[:h], y, py, least, reach, a, b)
        yield from join_intervals(x[h:], px[h:], y, py, least, reach, a + h, b)
    else:
        h = len(y) // 2
        yield from join_intervals(x, px, y[:h], py[:h], least, reach, a, b)
        yield from join_intervals(x, px, y[h:], py[h:], least, reach, a, b + h)


def links(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; a pair of one label links at cosine >= least."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, by_length = _matrix(batch.column(3))
            vecs = [None] * batch.num_rows
            for _, rows, x in by_length:
                for r, v in zip(rows.tolist(), x):
                    vecs[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vecs, pa.binary())], ["id", "uid", "label", "vec"])

    raw = vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = written(raw.mapInArrow(packed, f"id {kind}, uid bigint, label {label_kind}, vec binary"))
    own = F.struct(F.col("id").isNull().alias("none"), "id").alias("first")
    usable = rows.where("vec is not null and label is not null")
    classes = written(usable.groupBy("label", "vec").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(own).alias("first")))
    axes = _moments(classes)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, places = [None] * batch.num_rows, [None] * batch.num_rows
            sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False) // 8
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                p = _unit(np.frombuffer(b"".join(batch.column(0).take(pa.array(at)).to_pylist()), "<f8").reshape(-1, d)) @ axes[int(d)]
                for r, place, cell in zip(at.tolist(), p, np.floor(p / reach).astype(np.int64)):
                    cells[r], places[r] = cell.tolist(), place.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int64)), pa.array(cells, pa.list_(pa.int64())), pa.array(places, pa.binary()), *batch.columns], ["d", "cell", "place", "vec", "label", "node", "copies"])

    grid = classes.select("vec", "label", "node", "copies").mapInArrow(projected, f"d bigint, cell array<bigint>, place binary, vec binary, label {label_kind}, node bigint, copies bigint")
    grid = grid.repartitionByRange("label", "d", "cell", "node").sortWithinPartitions("label", "d", "cell", "node")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, d = batch.column(4).to_pylist(), batch.column(0).to_numpy()
            change = [0, *[i for i in range(1, len(label)) if label[i] != label[i - 1] or d[i] != d[i - 1]], len(label)]
            for a, b in zip(change, change[1:]):
                for s in range(a, b, BLOCK):
                    part = batch.slice(s, min(BLOCK, b - s))
                    place = np.frombuffer(b"".join(part.column(2).to_pylist()), "<f8").reshape(part.num_rows, -1)
                    vec = b"".join(part.column(3).to_pylist())
                    nodes, copies = part.column(5).to_numpy(), part.column(6).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(4).slice(0, 1), part.column(0).slice(0, 1), pa.array([place.min(0).tolist()]), pa.array([place.max(0).tolist()]), pa.array([nodes.tobytes() + copies.tobytes() + place.tobytes() + vec], pa.binary()), pa.array([part.num_rows], pa.int64())],
                        ["label", "d", "lo", "hi", "data", "n"],
                    )

    blocks = grid.mapInArrow(blocks_of, f"label {label_kind}, d bigint, lo array<double>, hi array<double>, data binary, n bigint")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()))

    cell = lambda x, i: F.floor(F.coalesce(F.try_element_at(x, F.lit(i)), F.lit(0.0)) / reach).cast("bigint")
    spread = lambda i, more: F.explode(F.sequence(cell(F.col("lo"), i) - more, cell(F.col("hi"), i) + more))
    box = blocks.select("block", "label", "d", "lo", "hi")
    left = box.withColumn("c1", spread(1, 0)).withColumn("c2", spread(2, 0)).select("label", "d", "c1", "c2", F.col("block").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    right = box.withColumn("c1", spread(1, 1)).withColumn("c2", spread(2, 1)).select("label", "d", "c1", "c2", F.col("block").alias("y"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
    gaps = F.zip_with(F.zip_with("xlo", "yhi", lambda a, b: a - b), F.zip_with("ylo", "xhi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    pairs = left.join(right, ["label", "d", "c1", "c2"]).where("x <= y").where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach).select("x", "y", "d").distinct()
    data = blocks.select("block", "data", "n")
    work = pairs.join(data.toDF("x", "xdata", "xn"), "x").join(data.toDF("y", "ydata", "yn"), "y")

    def opened(raw: bytes, n: int, d: int):
        nodes, copies = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        m = min(DIRECTIONS, d)
        return nodes, copies, np.frombuffer(raw, "<f8", n * m, 16 * n).reshape(n, m), _unit(np.frombuffer(raw, "<f8", n * d, 16 * n + 8 * n * m).reshape(n, d))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, d, xd, xn, yd, yn = (batch.column(i)[k].as_py() for i in range(7))
                xnode, xcopies, xplace, xv = opened(xd, xn, d)
                ynode, ycopies, yplace, yv = opened(yd, yn, d)
                found = list(join_intervals(xv, xplace, yv, yplace, least, reach))
                i = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
                j = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
                if x == y:
                    i, j = i[i != j], j[i != j]
                    n = np.bincount(i, weights=ycopies[j], minlength=xn)
                    node, label = xnode, forest(xn, i, j)
                else:
                    n = np.concatenate([np.bincount(i, weights=ycopies[j], minlength=xn), np.bincount(j, weights=xcopies[i], minlength=yn)])
                    node, label = np.concatenate([xnode, ynode]), forest(xn + yn, np.concatenate([i, j + xn]), np.concatenate([j + xn, i]))
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(n[some].astype(np.int64))], ["a", "b", "n"])

    found = written(work.select("x", "y", "d", "xdata", "xn", "ydata", "yn").repartition("x", "y").mapInArrow(compare, "a bigint, b bigint, n bigint"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    reach_of = components(found.select("a", "b"))
    of = classes.select("label", "vec", "node", "copies", "first").join(counts, "node", "left").join(reach_of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = written(of.select("label", "vec", "component", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least_of = written(of.groupBy("component").agg(F.min("first").alias("least")))  # so that Spark can split a large component's rows
    of = of.join(least_of, "component").select("label", "vec", "n_links", F.col("least.id").alias("component_id"))
    linked = usable.join(of, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("vec is null or label is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
