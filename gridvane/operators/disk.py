"""Where an index lies on disk, and which of its nodes stay in memory.

A sector has 4096 bytes; sector 0 holds the metadata. Nodes lie by their numbers, 0 to n - 1: as many
to a sector as fit whole, or one node over several sectors if none does. Full vectors for reordering
follow behind the nodes, packed by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written

SECTOR = 4096
#: Share of the nodes that a cache by levels may hold.
CACHE_SHARE = 0.1


def node_bytes(dim: int, degree: int, value_bytes: int = 4) -> int:
    """A vector, the number of neighbours and room for `degree` of them."""
    return dim * value_bytes + 4 * (degree + 1)


def _places(number, each: int, first: int):
    """(sector, slot, sectors that n items take) of items of `each` bytes from sector `first` on."""
    per = SECTOR // each
    if per:
        return first + F.floor(number / per), number % per, lambda n: -(-n // per)
    wide = -(-each // SECTOR)
    return first + number * wide, F.lit(0).cast("bigint"), lambda n: n * wide


def layout(graph: DataFrame, n: int, dim: int, value_bytes: int = 4, reorder_dim: int = 0) -> DataFrame:
    """graph(id, nbrs) with (sector, slot), and with (reorder_sector, reorder_slot) if reorder_dim is given.

    Every node has room for the largest degree of the graph. A vector to reorder by must fit a sector.
    """
    degree = graph.agg(F.max(F.size("nbrs"))).first()[0] or 0
    number = F.col("id").cast("bigint")
    sector, slot, taken = _places(number, node_bytes(dim, degree, value_bytes), 1)
    out = graph.withColumn("sector", sector.cast("bigint")).withColumn("slot", slot)
    if not reorder_dim:
        return out
    if 4 * reorder_dim > SECTOR:
        raise ValueError(f"a vector of {reorder_dim} dimensions does not fit a sector")
    sector, slot, _ = _places(number, 4 * reorder_dim, 1 + taken(n))
    return out.withColumn("reorder_sector", sector.cast("bigint")).withColumn("reorder_slot", slot)


def write_layout(placed: DataFrame, path: str) -> None:
    """Writes a layout as Parquet in order of its sectors, so that a range of sectors reads few row groups."""
    placed.repartitionByRange("sector").sortWithinPartitions("sector", "slot").write.mode("overwrite").parquet(path)


def permute_codes(codes: DataFrame, order: DataFrame) -> DataFrame:
    """codes(id, code) under new numbers: order(new_id, old_id) must name every id once."""
    both = F.when(F.col("id").isNotNull() & F.col("old_id").isNotNull(), 1)
    pairs = codes.join(order, codes["id"] == order["old_id"], "full")
    n, named, known, new = pairs.agg(F.count_distinct("id"), F.count("old_id"), F.count(both), F.count_distinct("new_id")).first()
    if not n == named == known == new:
        raise ValueError(f"the order gives {named} rows {new} numbers, {known} of them known, and there are {n} codes")
    return codes.join(order, codes["id"] == order["old_id"]).select(F.col("new_id").alias("id"), "code")


def cache_by_levels(edges: DataFrame, starts: DataFrame, n: int, total: int) -> DataFrame:
    """(id, level) of the first n nodes by breadth from starts(id, place), at most a tenth of all and at least one.

    Starts go by place; a level's nodes by (smallest parent, id), and the last level is cut there.
    """
    tenth = int(total * CACHE_SHARE + 0.5)
    n = n if n <= tenth else max(1, tenth)
    first = starts.groupBy("id").agg(F.min("place").alias("place")).orderBy("place", "id").limit(n)
    seen = frontier = written(first.select("id", F.lit(0).cast("bigint").alias("level")))
    held, level = seen.count(), 0
    while held < n:
        level += 1
        near = frontier.join(edges, frontier["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = near.join(seen, "id", "left_anti").orderBy("parent", "id").limit(n - held)
        frontier = written(fresh.select("id", F.lit(level).cast("bigint").alias("level")))
        more = frontier.count()
        if not more:
            break
        seen, held = written(seen.unionByName(frontier)), held + more
    return seen


def cache_by_visits(visits: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(id, n_visits) of the n nodes(id) that sample queries visited most, the smaller id of equals; all if there are no more."""
    counts = visits.groupBy("id").agg(F.count(F.lit(1)).alias("n_visits"))
    x = nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n_visits", F.lit(0)).alias("n_visits"))
    return x.orderBy(F.desc("n_visits"), "id").limit(n)


def union_pools(*pools: DataFrame) -> DataFrame:
    """(query_id, id): candidates of several searches, each once, such as those with and without a label."""
    out = pools[0].select("query_id", "id")
    for p in pools[1:]:
        out = out.unionByName(p.select("query_id", "id"))
    return out.distinct()


def without_frozen(found: DataFrame, n_points: int, k: int) -> DataFrame:
    """The k best of found(query_id, id, distance) once frozen points, numbered from n_points on, are left out."""
    from .knn import ranked

    return ranked(found.where(F.col("id") < n_points).select("query_id", "id", "distance"), k).select("query_id", "rank", "id", "distance")
