"""Graph tables: edges(src, dst) and graph(id, nbrs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_squared


def to_edges(graph: DataFrame) -> DataFrame:
    """(src, dst, place) of graph(id, nbrs)."""
    return graph.select(F.col("id").alias("src"), F.posexplode("nbrs").alias("place", "dst")).select("src", "dst", "place")


def to_graph(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, nbrs) with neighbours ascending; nodes(id) without edges get an empty list."""
    g = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    if nodes is None:
        return g
    return nodes.select("id").join(g, "id", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast(g.schema["nbrs"].dataType)))


def undirected(edges: DataFrame) -> DataFrame:
    """(id, nbrs) of edges in both directions, without loops and copies, ascending."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    return to_graph(both)


def degree_stats(graph: DataFrame) -> DataFrame:
    """One row: largest, mean and smallest degree, and how many nodes have less than two neighbours."""
    n = F.size("nbrs").cast("bigint")
    return graph.agg(F.max(n).alias("max_degree"), F.avg(n).alias("avg_degree"), F.min(n).alias("min_degree"), F.sum((n < 2).cast("bigint")).alias("n_below_two"))


def bfs(edges: DataFrame, start: DataFrame, depth: int = 32) -> DataFrame:
    """(id, level) of the nodes within `depth` hops of start(id).

    A level is a join of the frontier with the edges and an anti join with what was seen; each is
    written to the shared folder, so plans do not grow with the depth.
    """
    from ..plans.tables import written

    seen = written(start.select("id").distinct().withColumn("level", F.lit(0).cast("bigint")))
    frontier = seen
    for level in range(1, depth + 1):
        near = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = written(near.join(seen, "id", "left_anti").withColumn("level", F.lit(level).cast("bigint")))
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier))
    return seen


def bfs_levels(edges: DataFrame, start: DataFrame, depth: int = 32) -> DataFrame:
    """(level, n_nodes)"""
    return bfs(edges, start, depth).groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))


def khop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(start_id, id) of the nodes that a start(id) reaches in 1 to `hops` hops, itself left out."""
    reach = start.select(F.col("id").alias("start_id"), F.col("id").alias("at"))
    out = None
    for _ in range(hops):
        reach = reach.join(edges, reach["at"] == edges["src"]).select("start_id", F.col("dst").alias("at")).distinct()
        out = reach if out is None else out.unionByName(reach)
    return out.where("start_id <> at").distinct().select("start_id", F.col("at").alias("id"))


def union_truncate(graphs: list[DataFrame], degree: int) -> DataFrame:
    """(src, dst): the union of edge tables without copies, at most `degree` a node, chosen by a fixed shuffle."""
    union = None
    for g in graphs:
        union = g.select("src", "dst") if union is None else union.unionByName(g.select("src", "dst"))
    mixed = (F.col("dst") * 2654435761 + F.col("src") * 40503) % 1000003
    order = Window.partitionBy("src").orderBy(mixed, "dst")
    return union.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= degree).select("src", "dst")


def permute(edges: DataFrame, order: DataFrame) -> DataFrame:
    """edges under new numbers: order(new_id, old_id)."""
    a = order.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    b = order.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def centroid(vectors: DataFrame) -> DataFrame:
    """(pos, value): the mean of each component, positions from 0."""
    return vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy(F.col("pos").cast("bigint").alias("pos")).agg(F.avg(F.col("x").cast("double")).alias("value"))


def medoid(vectors: DataFrame) -> DataFrame:
    """One row (id, distance): the vector nearest to the centroid in squared L2; the smallest id of equals."""
    mean = [r.value for r in centroid(vectors).orderBy("pos").collect()]  # one value a dimension
    d = l2_squared(F.col("vec"), F.array(*[F.lit(x) for x in mean]))
    return vectors.select("id", d.alias("distance")).orderBy("distance", "id").limit(1)


def nearest_centres(vectors: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """(id, rank, centre, distance) of the k centres(query_id, vec) nearest to each vector.

    Every task gets the centres, some for each shard of an index, and goes through them in blocks.
    """
    from .knn import QUERY_BLOCK, distances

    import numpy as np
    import pyarrow as pa

    rows = sorted(centres.select("query_id", "vec").collect())
    ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([list(map(float, r[1])) for r in rows])

    def assign(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            vec = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(own), -1)
            best, who = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64)
            for a in range(0, len(ids), QUERY_BLOCK):
                d = np.concatenate([best, distances("l2", matrix[a : a + QUERY_BLOCK], vec).T], 1)
                of = np.concatenate([who, np.broadcast_to(ids[a : a + QUERY_BLOCK], (len(own), min(QUERY_BLOCK, len(ids) - a)))], 1)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]  # earlier blocks have smaller ids and come first
                best, who = np.take_along_axis(d, order, 1), np.take_along_axis(of, order, 1)
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.tile(np.arange(1, n + 1), len(own))), pa.array(who.ravel()), pa.array(best.ravel())], ["id", "rank", "centre", "distance"])

    return vectors.select("id", "vec").mapInArrow(assign, "id bigint, rank bigint, centre bigint, distance double")
