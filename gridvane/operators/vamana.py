"""Graph indexes as tables: build, search, merge, stitch, insert and consolidate.

An index is index(shard, id, vec, nbrs, labels, start): neighbours are ids within the shard, start
marks the entry point. Shards have a bounded size, so every step is a group of Arrow tables and
nothing is broadcast but a block of queries. A small table is one shard; a large one is split by
k-means with each point in its two nearest shards, every shard is searched, and results are merged.
Distances that are returned are measured in double.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import check_metric
from ..plans.tables import written
from . import kernels, partition, pq
from .graph import nearest_centres
from .knn import QUERY_BLOCK, _Nearest, _pairwise, distances, paired, ranked

DEFAULTS = {"degree": 64, "width": 100, "alpha": 1.2, "most": 750}
#: Points of a shard, at most about.
SHARD = 20_000
#: Points of a shard up to which all distances to a block of queries are worked out together, and distances at once.
SMALL, AT_ONCE = 2048, 1 << 18
_INDEX = "shard int, id bigint, vec array<float>, nbrs array<bigint>, labels array<bigint>, start boolean"
#: What a step changed: vec and labels are null where only the list of a point did; gone: the point was taken away.
CHANGES = _INDEX + ", gone boolean"
#: Searches of a larger shard in step, at most, and marks of what they have seen.
IN_STEP, SEEN = 512, 1 << 25
#: Ids from here on stand for start points that are no rows of the table.
_FROZEN = -(1 << 63)


def check_build(degree: int, width: int, alpha: float) -> None:
    if degree <= 0 or width <= 0:
        raise ValueError("degree and complexity must be positive")
    if alpha < 1:
        raise ValueError("alpha must be at least 1")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _ready(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the kernels want them: unit length for cosine."""
    if metric == "cosine":
        x = x / np.maximum(1e-30, np.sqrt((x * x).sum(1, keepdims=True)))
    return x.astype(np.float32)


def is_frozen(ids):
    """Which ids, in numpy or as a column, stand for start points that no vector of the table has."""
    return ids < _FROZEN + (1 << 32)


def start_points(x: np.ndarray, n: int, kind: str = "medoid", radius: float = 1.0, seed: int = 0) -> np.ndarray:
    """n vectors to start from: copies of the medoid of x, or random ones at a distance of `radius` from the origin."""
    if kind == "medoid":
        return np.repeat(x[kernels.medoid_of(x)][None], n, axis=0)
    if kind != "sphere":
        raise ValueError("start points are copies of the medoid or random on a sphere")
    v = np.random.default_rng(seed).normal(size=(n, x.shape[1]))
    return radius * v / np.sqrt((v * v).sum(1, keepdims=True))


def empty(spark: SparkSession, dims: int, n: int = 1, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """An index without vectors: one shard of n random start points, each linked to the others, to insert into."""
    if n < 1 or dims < 1:
        raise ValueError("an empty index has a start point and a dimension")
    vecs = start_points(np.zeros((0, dims)), n, "sphere", radius, seed)
    ids = [_FROZEN + i for i in range(n)]
    rows = [(0, ids[i], [float(v) for v in vecs[i]], [j for j in ids if j != ids[i]], None, i == 0) for i in range(n)]
    return spark.createDataFrame(rows, _INDEX)


def _rows(shard: int, ids, vec: pa.Array, lists: list[np.ndarray], labels, start) -> pa.Table:
    """start: a number, or an array of them."""
    flags = np.zeros(len(ids), bool)
    if len(ids):
        flags[start] = True
    return pa.table([pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), vec.cast(pa.list_(pa.float32())), pa.array([ids[v] for v in lists], pa.list_(pa.int64())), labels, pa.array(flags)], names=["shard", "id", "vec", "nbrs", "labels", "start"])


def _local(table: pa.Table):
    """(ids, vectors, neighbour lists in local numbers, entry) of a shard's rows, by id."""
    table = table.combine_chunks().sort_by("id")
    ids = table.column("id").to_numpy()
    lists = [np.searchsorted(ids, np.array(v or [], np.int64)) for v in table.column("nbrs").to_pylist()]
    start = np.flatnonzero(table.column("start").combine_chunks().to_numpy(zero_copy_only=False))
    return table, ids, _matrix(table.column("vec")), lists, start if len(start) else np.zeros(1, np.int64)


def _graph(metric: str) -> str:
    """What graphs are built by: fast_l2 ranks the neighbours of one point like l2, but is no distance between points."""
    return "l2" if metric == "fast_l2" else metric


def _dealt(rows: DataFrame, tasks: int = 0) -> DataFrame:
    """rows with the shards spread evenly over tasks; left alone, some tasks would get several shards and others none."""
    spark = rows.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartitionById(tasks, F.col("shard"))


def _with_labels(vectors: DataFrame) -> DataFrame:
    return vectors if "labels" in vectors.columns else vectors.withColumn("labels", F.lit(None).cast("array<bigint>"))


def assign_shards(vectors: DataFrame, most: int, copies: int = 2, seed: int = 0) -> DataFrame:
    """vectors with a shard column: each row in its `copies` nearest of parts that grew until each holds `most` rows at most.

    Parts that still hold more, as equal vectors do, are dealt by a hash of the id.
    """
    tree = partition.fit(vectors, most, copies, seed)
    near = partition.nearest_parts(vectors, tree, copies).select("id", F.col("part").alias("shard"))
    return partition.bounded(vectors.join(near, "id"), most)


def build(vectors: DataFrame, degree: int = DEFAULTS["degree"], width: int = DEFAULTS["width"], alpha: float = DEFAULTS["alpha"], metric: str = "l2", shard_size: int = SHARD, copies: int = 2, seed: int = 0, filtered: bool = False, book: pq.Codebook | None = None, frozen: int = 0, frozen_kind: str = "medoid", radius: float = 1.0) -> DataFrame:
    """An index of vectors(id, vec[, labels]); above shard_size rows in overlapping shards of two thirds the degree.

    filtered: pools and pruning mind the labels, so that the points of a label stay connected. book:
    points are compared by their product codes, as where the vectors themselves would not fit. frozen:
    so many start points are put into each shard beside the vectors (see start_points); a search starts
    from them, walks them and never returns them, and they outlive every deletion.
    """
    check_build(degree, width, alpha)
    check_metric(metric)
    one = vectors.limit(shard_size + 1).count() <= shard_size
    own = degree if one else max(4, 2 * degree // 3)

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("vec"))
        x = book.decode(book.encode(x)) if book is not None else x
        vec, labels = table.column("vec").combine_chunks(), table.column("labels").combine_chunks()
        if frozen:
            first = start_points(x, frozen, frozen_kind, radius, seed)
            ids, x = np.concatenate([_FROZEN + np.arange(frozen), ids]), np.concatenate([first, x])
            vec = pa.concat_arrays([pa.array(list(first.astype(np.float32)), pa.list_(pa.float32())), vec.cast(pa.list_(pa.float32()))])
            labels = pa.concat_arrays([pa.nulls(frozen, labels.type), labels])
        sets = [frozenset(v or ()) for v in labels.to_pylist()] if filtered else None
        adjacency, start = kernels.build(_ready(x, metric), own, width, alpha, _graph(metric), seed, labels=sets, start=0 if frozen else None)
        return _rows(table.column("shard")[0].as_py(), ids, vec, [r[r >= 0] for r in adjacency], labels, np.arange(frozen) if frozen else start)

    rows = _with_labels(vectors).select("id", F.col("vec").cast("array<float>").alias("vec"), F.col("labels").cast("array<bigint>").alias("labels"))
    rows = rows.withColumn("shard", F.lit(0)) if one else _dealt(assign_shards(rows, shard_size, copies, seed), 2 * math.ceil(vectors.count() * copies / shard_size))
    return rows.groupBy("shard").applyInArrow(make, _INDEX)


def points_within(dims: int, degree: int, budget_bytes: int) -> int:
    """How many points a task's memory budget holds: a vector, a list with its slack, and what goes with them."""
    each = 4 * dims + 8 * math.ceil(1.3 * degree) + 64
    if budget_bytes < each:
        raise ValueError("the budget does not hold a single point")
    return budget_bytes // each


def build_within(vectors: DataFrame, budget_bytes: int, degree: int = DEFAULTS["degree"], width: int = DEFAULTS["width"], alpha: float = DEFAULTS["alpha"], metric: str = "l2", **options) -> DataFrame:
    """build() in the fewest of 1, 3, 5, ... shards that each fit into a task's memory budget."""
    dims = vectors.select(F.size("vec").alias("d")).first()
    return build(vectors, degree, width, alpha, metric, shard_size=points_within(dims.d if dims else 1, degree, budget_bytes), **options)


def build_stitched(points: DataFrame, degree: int = 64, width: int = 100, alpha: float = 1.2, metric: str = "l2", stitched_degree: int | None = None, seed: int = 0, shard_size: int = SHARD) -> DataFrame:
    """One graph out of a graph for each label: points(id, vec, labels).

    Above shard_size rows this is done in each of several shards, as in build(). Edges are united,
    each once, and lists above stitched_degree are pruned with the vectors of their neighbours at
    hand. The entry points are those of the labels.
    """
    check_build(degree, width, alpha)
    most = stitched_degree or degree
    points = points.select("id", F.col("vec").cast("array<float>").alias("vec"), "labels")
    one = points.limit(shard_size + 1).count() <= shard_size
    points = points.withColumn("shard", F.lit(0)) if one else written(assign_shards(points, shard_size, 2, seed))
    exploded = points.select("shard", "id", "vec", F.explode("labels").alias("label"))

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids = table.column("id").to_numpy()
        adjacency, start = kernels.build(_ready(_matrix(table.column("vec")), metric), degree, width, alpha, _graph(metric), seed)
        src, k = np.nonzero(adjacency >= 0)
        n, shard = len(src), table.column("shard")[0].as_py()
        return pa.table([pa.array([shard] * (n + 1), pa.int32()), pa.array(np.append(ids[src], ids[start])), pa.array(np.append(ids[adjacency[src, k]], -1)), pa.array([False] * n + [True])], names=["shard", "src", "dst", "start"])

    links = exploded.groupBy("shard", "label").applyInArrow(make, "shard int, src bigint, dst bigint, start boolean").distinct()
    starts = links.where("start").select("shard", F.col("src").alias("id")).distinct()
    near = points.select("shard", F.col("id").alias("dst"), F.col("vec").alias("nvec"))
    full = links.where("not start").select("shard", "src", "dst").join(near, ["shard", "dst"]).join(points.select("shard", F.col("id").alias("src"), "vec"), ["shard", "src"])

    def cut(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("dst")
        dst = table.column("dst").to_numpy()
        x = _ready(np.concatenate([_matrix(table.column("nvec")), _matrix(table.column("vec"))[:1]]), metric)
        keep = np.arange(len(dst))
        if len(dst) > most:
            keep = kernels.robust_prune(keep, kernels.pairwise(_graph(metric), x[-1:], x[:-1])[0], x, most, alpha, metric=_graph(metric))
        return pa.table([table.column("shard")[:1], table.column("src")[:1], pa.array([dst[keep].tolist()], pa.list_(pa.int64()))], names=["shard", "id", "nbrs"])

    pruned = full.groupBy("shard", "src").applyInArrow(cut, "shard int, id bigint, nbrs array<bigint>")
    x = points.select("shard", "id", "vec", F.col("labels").cast("array<bigint>").alias("labels")).join(pruned, ["shard", "id"], "left").join(starts.withColumn("start", F.lit(True)), ["shard", "id"], "left")
    return x.select("shard", "id", "vec", F.coalesce("nbrs", F.expr("cast(array() as array<bigint>)")).alias("nbrs"), "labels", F.coalesce("start", F.lit(False)).alias("start"))


def merge_shards(index: DataFrame, degree: int) -> DataFrame:
    """(src, dst): one edge table out of all shards, without copies, at most `degree` a node."""
    from .graph import union_truncate

    edges = index.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))
    return union_truncate([edges.where(~is_frozen(F.col("src")) & ~is_frozen(F.col("dst")))], degree)


def _query_blocks(queries: DataFrame, label: bool):
    rows = []
    for r in queries.select("query_id", "vec", *(["label"] if label else [])).toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            yield rows
            rows = []
    if rows:
        yield rows


def search(index: DataFrame, queries: DataFrame, k: int, width: int, metric: str = "l2", universal: int | None = None, tombstones: DataFrame | None = None, book: pq.Codebook | None = None, beam: int = 1, io_limit: int = 0, radius: float | None = None, seeds: DataFrame | None = None, random_starts: bool = False) -> DataFrame:
    """(query_id, rank, id, distance, hops, n_compared, n_ios) by graph search in every shard.

    seeds(id, seed): whose pages nodes lie on; a beam prefers nodes that lie together. random_starts:
    the list begins with the entry point, its neighbours and random points up to its width, as a search
    by fast_l2 does; an index built for l2 serves it.

    queries(query_id, vec[, label]): with a label only points that have it (or the universal one) are
    met. book: product codes guide the search and only expanded nodes are measured in full, as on
    disk; n_ios counts the nodes read. radius: all points found within it are returned, and the list
    doubles while at least half of it lies within. Deleted points are walked but not returned.
    """
    check_metric(metric)
    if k <= 0 or width <= 0:
        raise ValueError("k and complexity must be positive")
    if k > width and radius is None:
        raise ValueError("complexity must be at least k")
    label = "label" in queries.columns
    schema = "query_id bigint, id bigint, distance double, hops bigint, n_compared bigint, n_ios bigint"
    if tombstones is not None:
        index = index.join(tombstones.select("id").distinct().withColumn("dead", F.lit(True)), "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    else:
        index = index.withColumn("dead", F.lit(False))
    if seeds is not None:
        index = index.join(seeds.select("id", F.col("seed").cast("bigint").alias("seed")), "id", "left").withColumn("seed", F.coalesce("seed", "id"))
    # a search without extras meets its shards one after another, a partition's at a time, and keeps k of what they give
    plain = metric == "l2" and not label and book is None and beam == 1 and not io_limit and radius is None and seeds is None and not random_starts
    if plain:
        index = index.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard")
    else:
        index = _dealt(index)
    out = None
    for block in _query_blocks(queries, label):
        found = index.mapInArrow(_plain_searcher(block, k, width), schema) if plain else index.groupBy("shard").applyInArrow(_searcher(block, label, k, width, metric, universal, book, beam, io_limit, radius, random_starts), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = index.sparkSession.createDataFrame([], schema)
    stats = out.groupBy("query_id").agg(F.max("hops").alias("hops"), F.sum("n_compared").alias("n_compared"), F.sum("n_ios").alias("n_ios"))
    # statistics come on rows without an id, so a query that found nothing has them too
    best = out.where("id is not null").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    top = ranked(best, k if radius is None else 1 << 30)
    return top.join(stats, "query_id").select("query_id", "rank", "id", "distance", "hops", "n_compared", "n_ios")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The shards of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("shard")[0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _plain_searcher(block, k, width):
    """Searches all shards of a partition by L2 for a block of queries; leaves k rows and one of statistics for each query."""
    query_ids, q = np.array([r["query_id"] for r in block], np.int64), np.array([r["vec"] for r in block], np.float64)

    def listed(qx: np.ndarray, x: np.ndarray, nbrs: np.ndarray, starts: np.ndarray):
        """(query, node) of what is on the lists of some queries in the end, the distances, hops and comparisons"""
        if len(x) <= SMALL:
            d = kernels.pairwise("l2", qx, x)
            if np.isfinite(d).all():
                order, held, hops, compared = kernels.walked(d, nbrs, starts, width)
                row, at = np.nonzero(held)
                node = order[row, at]
                return row, node, d[row, node], hops, compared
        if np.isfinite(qx).all() and np.isfinite(x).all():
            node, d, _, hops, compared = kernels.stepped(qx, x, nbrs, np.broadcast_to(np.unique(starts), (len(qx), len(np.unique(starts)))), width)
            row, at = np.nonzero(node >= 0)
            return row, node[row, at], d[row, at], hops, compared
        found = [kernels.greedy_search(v, x, nbrs, starts, width) for v in qx]
        node, d = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        return np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), node, d, np.array([f[3] for f in found]), np.array([f[4] for f in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, hops, compared, ios, any_shard = _Nearest(len(q), k), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), False
        for table in _shards(batches):
            any_shard = True
            table, ids, full, lists, starts = _local(table)
            x = _ready(full, "l2")
            nbrs = kernels.padded(lists, max((len(v) for v in lists), default=1))
            dead = table.column("dead").combine_chunks().to_numpy(zero_copy_only=False) | is_frozen(ids)
            # single precision errs by no more than this, see knn._meet
            unit, longest = (full.shape[1] + 16) * 2.0**-24, np.sqrt((full * full).sum(1).max(initial=0))
            step = max(1, AT_ONCE // len(x) if len(x) <= SMALL else min(IN_STEP, SEEN // len(x)))
            for a in range(0, len(q), step):
                part = np.arange(a, min(a + step, len(q)))
                row, node, d, h, c = listed(_ready(q[part], "l2"), x, nbrs, starts)
                hops[part], compared[part], ios[part] = np.maximum(hops[part], h), compared[part] + c, ios[part] + h
                row, node, d = (v[~dead[node]] for v in (row, node, d))
                # of each query, the k nearest of the list by these distances, what may tie with them, and nothing that is farther than what other shards gave
                slack = unit * (np.sqrt((q[part] * q[part]).sum(1)) + longest) ** 2 + 1e-37
                begin = np.searchsorted(row, np.arange(len(part) + 1))
                kth = begin[:-1] + k - 1
                limit = np.where(kth < begin[1:], np.append(d, 0)[np.minimum(kth, len(d))] + 2 * slack, np.inf)
                limit = np.fmin(limit, best.d[part, -1] + slack)
                near = ~(d > limit[row])
                row, node = part[row[near]], node[near]
                new = ~(best.id[row] == ids[node][:, None]).any(1)  # a point may be in two shards
                row, node = row[new], node[new]
                if len(row):
                    best.add(row, _pairwise(q[row], full[node]), ids[node])
        if any_shard:
            who, ids, d = best.rows(query_ids)
            names = ["query_id", "id", "distance", "hops", "n_compared", "n_ios"]
            zero, n = pa.array(np.zeros(len(who), np.int64)), len(query_ids)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids), pa.array(d), zero, zero, zero], names)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(hops), pa.array(compared), pa.array(ios)], names)

    return run


def _in_step(ids, full, lists, starts, dead, q, qx, entries, k, width, metric, allowed=None):
    """(query, id, distance) of the k nearest that searches of one shard find, hops and comparisons; entries: where each begins."""
    x, nbrs = _ready(full, metric), kernels.padded(lists, max((len(v) for v in lists), default=1))
    out, hops, compared = [], np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    step = max(1, min(IN_STEP, SEEN // len(x)))
    for members, mask in allowed if allowed is not None else [(np.arange(len(q)), None)]:
        for a in range(0, len(members), step):
            part = members[a : a + step]
            first = [entries(i) for i in part.tolist()]
            got, _, _, hops[part], compared[part] = kernels.stepped(qx[part], x, nbrs, kernels.padded(first, max(map(len, first))), width, metric, mask)
            row, at = np.nonzero(got >= 0)
            node = got[row, at]
            row, node = row[~dead[node]], node[~dead[node]]
            d = paired(metric, q[part[row]], full[node])
            order = np.lexsort((ids[node], d, row))
            row, node, d = row[order], node[order], d[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((part[row[near]], ids[node[near]], d[near]))
    return [np.concatenate(v) for v in zip(*out)], hops, compared


def _searcher(block, label, k, width, metric, universal, book, beam, io_limit, radius, random_starts):
    query_ids, vecs = np.array([r["query_id"] for r in block], np.int64), np.array([r["vec"] for r in block], np.float64)

    def in_step(table, ids, full, lists, starts, dead) -> pa.Table:
        def some(i: int) -> np.ndarray:
            some = np.random.default_rng(int(query_ids[i]) & 0xFFFFFFFF).choice(len(ids), min(width, len(ids)), replace=False)
            return np.unique(np.concatenate([starts, *[lists[s] for s in starts], some]))

        groups, first = None, np.unique(starts)
        entries = some if random_starts else lambda i: first
        if label:
            members = kernels.members_of(table.column("labels").to_pylist())
            firsts = kernels.label_starts(members, len(ids))
            asking: dict = {}
            for i, r in enumerate(block):
                asking.setdefault(r["label"], []).append(i)
            begin, groups = {}, []
            for v, own in asking.items():
                mask = np.zeros(len(ids), bool)
                known = {v, universal if universal is not None else v} & members.keys()
                for name in known:
                    mask[members[name]] = True
                # the shard's entry points that have the label, and the label's own start
                begin[v] = np.unique(np.append(starts[mask[starts]], np.array([firsts[name] for name in known], np.int64)))
                groups.append((np.array(own), mask))
            entries = lambda i: begin[block[i]["label"]]
        (who, found, d), hops, compared = _in_step(ids, full, lists, starts, dead, vecs, _ready(vecs, metric), entries, k, width, metric, groups)
        n, rows = len(block), len(who)
        nulls = pa.array(np.arange(rows + n) >= rows)
        columns = [
            pa.array(np.concatenate([query_ids[who], query_ids])),
            pa.compute.if_else(nulls, pa.nulls(rows + n, pa.int64()), pa.array(np.concatenate([found, np.zeros(n, np.int64)]))),
            pa.compute.if_else(nulls, pa.nulls(rows + n, pa.float64()), pa.array(np.concatenate([d, np.zeros(n)]))),
            *[pa.array(np.concatenate([np.zeros(rows, np.int64), v])) for v in (hops, compared, hops)],
        ]
        return pa.table(columns, names=["query_id", "id", "distance", "hops", "n_compared", "n_ios"])

    def run(table: pa.Table) -> pa.Table:
        table, ids, full, lists, starts = _local(table)
        dead = table.column("dead").combine_chunks().to_numpy(zero_copy_only=False) | is_frozen(ids)
        if book is None and beam == 1 and not io_limit and radius is None and "seed" not in table.column_names and np.isfinite(full).all() and np.isfinite(vecs).all():
            return in_step(table, ids, full, lists, starts, dead)
        x = _ready(full, metric)
        nbrs = kernels.padded(lists, max((len(v) for v in lists), default=1))
        members = kernels.members_of(table.column("labels").to_pylist()) if label else {}
        firsts = kernels.label_starts(members, len(ids))
        codes = book.encode(full) if book is not None else None
        own_seeds = table.column("seed").to_numpy() if "seed" in table.column_names else None
        masks: dict = {}
        rows = []
        for r in block:
            q = np.array([r["vec"]], np.float64)
            qx = _ready(q, metric)[0]
            allowed, entry = None, starts
            if random_starts:
                some = np.random.default_rng(int(r["query_id"]) & 0xFFFFFFFF).choice(len(x), min(width, len(x)), replace=False)
                entry = np.unique(np.concatenate([starts, *[lists[s] for s in starts], some]))
            if label:
                if r["label"] not in masks:
                    mask, first = np.zeros(len(x), bool), []
                    for v in {r["label"], universal if universal is not None else r["label"]} & members.keys():
                        mask[members[v]] = True
                        first.append(firsts[v])
                    # the shard's entry points that have the label, and the label's own start
                    masks[r["label"]] = mask, np.append(starts[mask[starts]], np.array(first, np.int64))
                allowed, entry = masks[r["label"]]
            measure = None
            if book is not None:
                tables = book.tables(q, "l2" if metric != "ip" else "ip")
                measure = lambda i: sum(t[0, codes[i, c]] for c, t in enumerate(tables))
            w = width
            while True:
                got, _, expanded, hops, compared = kernels.greedy_search(qx, x, nbrs, entry, w, metric, allowed, measure, beam, io_limit, own_seeds)
                pool = expanded if book is not None else got
                pool = pool[~dead[pool]]
                d = distances(metric, q, full[pool])[0] if len(pool) else np.zeros(0)
                if radius is None or (d <= radius).sum() < w / 2 or w >= len(x):
                    break
                w *= 2
            best = np.lexsort((ids[pool], d))
            best = best[:k] if radius is None else best[d[best] <= radius]
            rows.extend((r["query_id"], int(ids[pool[i]]), float(d[i]), 0, 0, 0) for i in best)
            rows.append((r["query_id"], None, None, hops, compared, len(expanded)))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "id", "distance", "hops", "n_compared", "n_ios"])

    return run


def insert(index: DataFrame, rows: DataFrame, degree: int = 64, width: int = 100, alpha: float = 1.2, metric: str = "l2") -> DataFrame:
    """The index with rows(id, vec[, labels]) linked in, each in the shard whose entry point is nearest.

    Labels are minded where points have some. A shard that would outgrow SHARD twice over should be built anew.
    """
    return merged(index, insert_changes(index, rows, degree, width, alpha, metric))


def insert_changes(index: DataFrame, rows: DataFrame, degree: int = 64, width: int = 100, alpha: float = 1.2, metric: str = "l2") -> DataFrame:
    """What insert() changes: the new points, and the older ones that got an edge. Only shards that get a point are read by the graph step."""
    # new columns throughout: rows may come from the index's own table
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    entries = index.where("start").groupBy("shard").agg(F.min_by("vec", "id").alias("vec")).select(F.col("shard").cast("bigint").alias("query_id"), "vec")
    placed = nearest_centres(rows, entries, 1).select("id", F.col("centre").cast("int").alias("shard"))
    new = _with_labels(rows).join(placed, "id").select(F.col("shard").alias("shard"), F.col("id").alias("id"), F.col("vec").cast("array<float>").alias("vec"), F.col("labels").cast("array<bigint>").alias("labels"))
    new = written(new)

    def link(old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return pa.schema(_EMPTY).empty_table()
        old, ids, full, lists, starts = _local(old)
        new = new.combine_chunks().sort_by("id")
        vec = pa.concat_arrays([old.column("vec").combine_chunks(), new.column("vec").combine_chunks()])
        labels = pa.concat_arrays([old.column("labels").combine_chunks(), new.column("labels").combine_chunks()])
        sets = [frozenset(v or ()) for v in labels.to_pylist()]
        first = len(ids)
        ids = np.concatenate([ids, new.column("id").to_numpy()])
        touched = kernels.insert(_ready(_matrix(vec), metric), lists, first, starts, degree, width, alpha, _graph(metric), sets if any(sets) else None)
        out = _rows(new.column("shard")[0].as_py(), ids, vec, lists, labels, starts)
        return _changes(out, np.concatenate([touched, np.arange(first, len(ids))]), first)

    near = index.join(new.select(F.col("shard").alias("shard")).distinct(), "shard", "left_semi")
    return _dealt(near).groupBy("shard").cogroup(_dealt(new).groupBy("shard")).applyInArrow(link, CHANGES)


_EMPTY = [("shard", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("nbrs", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("start", pa.bool_()), ("gone", pa.bool_())]


def _changes(rows: pa.Table, touched: np.ndarray, first: int) -> pa.Table:
    """The touched rows; those numbered below first keep their vector and labels elsewhere."""
    rows, older = rows.take(pa.array(touched)), pa.array(touched < first)
    columns = {name: rows.column(name).combine_chunks() for name in rows.column_names}
    for name in ("vec", "labels"):
        columns[name] = pa.compute.if_else(older, pa.nulls(len(touched), columns[name].type), columns[name])
    return pa.table(columns | {"gone": pa.array([False] * len(touched))}).cast(pa.schema(_EMPTY))


def merged(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after one step's changes. Few changes are broadcast by Catalyst, many are joined."""
    new = changes.select("shard", "id", *[F.col(c).alias(f"new_{c}") for c in ("vec", "nbrs", "labels", "start", "gone")])
    pick = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c)
    old = index.join(new, ["shard", "id"], "left").where("not coalesce(new_gone, false)")
    old = old.select("shard", "id", pick("vec"), F.when(F.col("new_gone").isNotNull(), F.col("new_nbrs")).otherwise(F.col("nbrs")).alias("nbrs"), pick("labels"), pick("start"))
    added = changes.where("vec is not null and not gone").join(index.select("shard", "id"), ["shard", "id"], "left_anti")
    return old.unionByName(added.select(*old.columns))


def consolidate(index: DataFrame, tombstones: DataFrame, degree: int = 64, alpha: float = 1.2, metric: str = "l2") -> DataFrame:
    """The index without the deleted points; their neighbours are linked to what they led to."""
    return merged(index, consolidate_changes(index, tombstones, degree, alpha, metric))


def consolidate_changes(index: DataFrame, tombstones: DataFrame, degree: int = 64, alpha: float = 1.2, metric: str = "l2") -> DataFrame:
    """What consolidate() changes: points that go, and points whose lists or start flags differ afterwards.

    Labels are minded where points have some: pruning keeps what leads on within a label, and the
    points of a label stay reachable from its start.
    """
    tombstones = tombstones.select(F.col("id").alias("id")).distinct()
    marked = index.join(tombstones.withColumn("dead", F.lit(True)), "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)) & ~is_frozen(F.col("id")))
    touched = marked.where("dead").select(F.col("shard").alias("shard")).distinct()

    def clean(table: pa.Table) -> pa.Table:
        table, ids, full, old, starts = _local(table)
        dead = table.column("dead").combine_chunks().to_numpy(zero_copy_only=False)
        x, n = _ready(full, metric), len(ids)
        sets = [frozenset(v or ()) for v in table.column("labels").to_pylist()]
        lists = kernels.drop(old, dead, x, degree, alpha, _graph(metric), sets if any(sets) else None)
        live = np.flatnonzero(~dead)
        flags = np.zeros(n, bool)
        if len(live):
            number = np.cumsum(~dead) - 1
            left = [number[lists[i]] for i in live]
            kept = number[starts[~dead[starts]]]
            kept = kept if len(kept) else np.array([kernels.medoid_of(x[live])])
            kernels._connect(left, int(kept[0]), x[live], degree, _graph(metric))
            if any(sets):
                kernels.connect_labels(left, [sets[i] for i in live], x[live], _graph(metric))
            flags[live[kept]] = True
            for i, v in zip(live.tolist(), left):
                lists[i] = live[v]
        before = np.zeros(n, bool)
        before[starts] = True
        differ = dead | (flags != before) | np.array([len(a) != len(b) or (a != b).any() for a, b in zip(old, lists)], bool)
        at = np.flatnonzero(differ)
        out = _rows(table.column("shard")[0].as_py(), ids, table.column("vec").combine_chunks(), lists, table.column("labels").combine_chunks(), np.flatnonzero(flags))
        out = _changes(out, at, n)
        return out.set_column(out.column_names.index("gone"), "gone", pa.array(dead[at]))

    return _dealt(marked.join(touched, "shard", "left_semi")).groupBy("shard").applyInArrow(clean, CHANGES)


def tune_beam(measure, first: int = 2, most: int = 64) -> int:
    """The beam width up to which measure(beam) -> (qps, mean, p999) gains, growing by a tenth at a time."""
    beam, best, at = float(first), first, -1.0
    while round(beam) <= most:
        qps, mean, tail = measure(round(beam))
        if qps <= at or tail >= 15_000 + 2 * mean:
            break
        best, at = round(beam), qps
        beam = max(beam * 1.1, beam + 0.5)
    return best
