"""Cache tiers and page layouts that are plain relational plans.

A layout is a node list (place, id), which may name a node twice, or pages
(page_seq, seed, page_no, is_cold, nodes). Budgets count slots. Parents are ranked by (out-heat
descending, id ascending). The greedy layouts are in plans.greedy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import profile
from ..operators.graph import undirected
from .numbering import numbered


def hot_nodes(node_profile: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(place, id, n_expand): expanded nodes by (n_expand descending, id), without excluded(id)."""
    x = node_profile.where("n_expand > 0")
    x = x.join(excluded.select("id"), "id", "left_anti") if excluded is not None else x
    return numbered(x.select("id", "n_expand"), F.desc("n_expand"), "id").select("place", "id", "n_expand")


def memory_tier(node_profile: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """The n hottest nodes after the first `skip`."""
    x = hot_nodes(node_profile)
    return x.where((F.col("place") > skip) & (F.col("place") <= skip + n)).select((F.col("place") - skip).alias("place"), "id", "n_expand")


def flat(node_profile: DataFrame, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """Disk tier: the n hottest nodes that the memory tier does not hold."""
    return hot_nodes(node_profile, excluded).where(F.col("place") <= n)


def plan_memory(n: int, aligned_dim: int, element_bytes: int, degree: int, host: int, baseline: int, reserve: int, requested: int) -> dict:
    """How many nodes fit into memory; ValueError if more is requested than the host has left."""
    per = aligned_dim * element_bytes + (degree + 1) * 4 + 64
    residual = max(0, host - baseline - reserve)
    if requested > residual:
        raise ValueError(f"{requested} bytes are requested, {residual} are left")
    return {"per_node": per, "residual": residual, "n_nodes": min(requested // per, residual // per, n)}


def plan_disk(base_bytes: int, ratio: float, sector: int, nodes_per_sector: int, replicas: bool = False) -> dict:
    """Budget of a disk cache; the ratio is at most 1, or 10 with replicas."""
    if not 0 < ratio <= (10 if replicas else 1):
        raise ValueError("ratio is out of range")
    budget = int(base_bytes * ratio)
    return {"budget": budget, "sectors": budget // sector, "n_nodes": budget // sector * nodes_per_sector}


def _eligible_edges(edge_profile: DataFrame, node_profile: DataFrame, excluded: DataFrame | None, share: float, cap: int, graph: DataFrame | None, cold: bool, seeds: bool = True) -> DataFrame:
    """(u, v, total, hot, n): a parent's eligible children after the cut, numbered anew among hot and cold ones."""
    good = hot_nodes(node_profile, excluded).select("id")
    x = profile.threshold(edge_profile, share, cap).withColumn("hot", F.col("rn") <= F.col("k"))
    x = x if cold else x.where("hot")
    x = x.join(good.withColumnRenamed("id", "v"), "v", "left_semi")
    x = x.join(good.withColumnRenamed("id", "u"), "u", "left_semi") if seeds else x
    if graph is not None:
        adjacent = undirected(graph).select(F.col("id").alias("u"), F.explode("nbrs").alias("v"))
        x = x.join(adjacent, ["u", "v"], "left_semi")
    return x.withColumn("n", F.row_number().over(Window.partitionBy("u", "hot").orderBy("rn")))


def seed_replica_pages(edge_profile: DataFrame, node_profile: DataFrame, share: float, cap: int, budget: int = 0, graph: DataFrame | None = None, excluded: DataFrame | None = None, rank: str = "heat") -> DataFrame:
    """Pages of parents with their hot children, then cold tails, in order of emission until the budget is used.

    First page 0 of every parent by rank, then page 1 of all, and so on, then cold pages likewise. A
    page goes out if fewer slots than the budget are taken before it, and goes out whole. rank: "heat",
    or "benefit" (heat over hot pages). A parent without an eligible hot child has no pages. budget 0: all.
    """
    if rank not in ("heat", "benefit"):
        raise ValueError("rank must be heat or benefit")
    x = _eligible_edges(edge_profile, node_profile, excluded, share, cap, graph, cold=share < 1.0)
    x = x.withColumn("page_no", F.when(F.col("hot"), profile.page_of(F.col("n"), cap)).otherwise(profile.page_of(F.col("n"), cap, seeded=False)))
    pages = x.groupBy("u", "hot", "page_no").agg(F.max("total").alias("heat"), F.sort_array(F.collect_list(F.struct("n", "v"))).alias("kids"))
    of = Window.partitionBy("u")
    pages = pages.withColumn("n_hot", F.sum(F.col("hot").cast("bigint")).over(of)).where("n_hot > 0")
    kids = F.transform("kids", lambda k: k["v"])
    nodes = F.when(F.col("hot") & (F.col("page_no") == 0), F.concat(F.array("u"), kids)).otherwise(kids)
    pages = pages.select(F.col("u").alias("seed"), (~F.col("hot")).alias("is_cold"), F.col("page_no").cast("bigint").alias("page_no"), nodes.alias("nodes"), "heat", (F.col("heat") / F.greatest(F.lit(1), F.col("n_hot"))).alias("benefit"))
    keys = [F.desc("benefit"), F.desc("heat"), F.col("seed")] if rank == "benefit" else [F.desc("heat"), F.col("seed")]
    pages = numbered(pages, "is_cold", "page_no", *keys, place="page_seq", before="before", value=F.size("nodes"))
    pages = pages.where(F.col("before") < budget) if budget else pages
    return pages.select("page_seq", "seed", "page_no", "is_cold", "nodes", "before")


def node_list(pages: DataFrame, budget: int = 0) -> DataFrame:
    """(place, id): the slots of pages in order, cut at the budget, maybe amid a page."""
    x = pages.select((F.col("before")).alias("before"), F.posexplode("nodes").alias("slot", "id")).select((F.col("before") + F.col("slot") + 1).alias("place"), "id")
    return x.where(F.col("place") <= budget) if budget else x


def append_hot(listed: DataFrame, node_profile: DataFrame, budget: int, excluded: DataFrame | None = None) -> DataFrame:
    """listed(place, id), then hot nodes that it lacks, until the budget."""
    last = listed.agg(F.coalesce(F.max("place"), F.lit(0)).alias("last"))
    seen = listed.select("id").distinct()
    more = hot_nodes(node_profile, seen if excluded is None else seen.unionByName(excluded.select("id")).distinct())
    more = more.join(F.broadcast(last)).select((F.col("last") + F.col("place")).alias("place"), "id")
    return listed.select("place", "id").unionByName(more).where(F.col("place") <= budget)


def core_fill(edge_profile: DataFrame, node_profile: DataFrame, share: float, cap: int, budget: int, core: float, graph: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(place, id): seed replicas in `core` of the slots (0.05 to 0.95), then distinct hot nodes."""
    slots = int(budget * min(0.95, max(0.05, core)))
    pages = seed_replica_pages(edge_profile, node_profile, share, cap, slots, graph, excluded)
    return append_hot(node_list(pages, slots), node_profile, budget, excluded)


def child_replica_pages(edge_profile: DataFrame, node_profile: DataFrame, share: float, cap: int, budget: int = 0, graph: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(page_seq, seed, page_no, nodes, before): pages of hot children only, parent after parent by heat; the last is cut."""
    x = _eligible_edges(edge_profile, node_profile, excluded, share, cap, graph, cold=False, seeds=False)
    return _child_pages(x, cap, budget)


def child_only_pages(edge_profile: DataFrame, node_profile: DataFrame, share: float, cap: int, budget: int = 0, graph: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """As child_replica_pages, but a child goes to the first parent by heat whose cut list has it, and nowhere else."""
    x = _eligible_edges(edge_profile, node_profile, excluded, share, cap, graph, cold=False, seeds=False)
    x = x.withColumn("first", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("total"), "u"))).where("first = 1").drop("first")
    return _child_pages(x.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy("rn"))), cap, budget)


def _child_pages(x: DataFrame, cap: int, budget: int) -> DataFrame:
    x = x.withColumn("page_no", profile.page_of(F.col("n"), cap, seeded=False).cast("bigint"))
    pages = x.groupBy("u", "page_no").agg(F.max("total").alias("heat"), F.sort_array(F.collect_list(F.struct("n", "v"))).alias("kids"))
    pages = pages.select("heat", F.col("u").alias("seed"), "page_no", F.transform("kids", lambda k: k["v"]).alias("nodes"))
    pages = numbered(pages, F.desc("heat"), "seed", "page_no", place="page_seq", before="before", value=F.size("nodes"))
    pages = pages.select("page_seq", "seed", "page_no", "nodes", "before")
    if budget:
        pages = pages.where(F.col("before") < budget).withColumn("nodes", F.slice("nodes", 1, (F.lit(budget) - F.col("before")).cast("int")))
    return pages


def permutation(pages: DataFrame, node_profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """(new_id, old_id) of all nodes(id): first by place on pages(page_seq, nodes), then by heat, then by id."""
    on = pages.select("page_seq", F.posexplode("nodes").alias("slot", "id")).groupBy("id").agg(F.min(F.struct("page_seq", "slot")).alias("at"))
    x = nodes.select("id").join(on, "id", "left").join(node_profile.select("id", "n_expand"), "id", "left")
    x = x.select("id", "at", F.coalesce("n_expand", F.lit(0)).alias("heat"))
    x = numbered(x, F.col("at").isNull(), "at", F.desc("heat"), "id", place="new_id", first=0)
    return x.select("new_id", F.col("id").alias("old_id"))


def spans(sectors: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, first, n): distinct sectors(by, sector) joined into runs of consecutive ones."""
    x = sectors.select(by, "sector").distinct()
    x = x.withColumn("island", F.col("sector") - F.row_number().over(Window.partitionBy(by).orderBy("sector")))
    return x.groupBy(by, "island").agg(F.min("sector").alias("first"), F.count(F.lit(1)).alias("n")).drop("island")


def sector_hits(reads: DataFrame) -> DataFrame:
    """(query_id, n_reads, n_distinct, n_hits): a sector read again in one query is a hit."""
    x = reads.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_reads"), F.countDistinct("sector").alias("n_distinct"))
    return x.withColumn("n_hits", F.col("n_reads") - F.col("n_distinct"))


def sector_jumps(reads: DataFrame) -> DataFrame:
    """(query_id, n_jumps, total_jump): distances between sectors read one after another, by reads(query_id, seq, sector)."""
    step = F.abs(F.col("sector") - F.lag("sector").over(Window.partitionBy("query_id").orderBy("seq")))
    x = reads.withColumn("step", step)
    return x.groupBy("query_id").agg(F.sum((F.col("step") > 1).cast("bigint")).alias("n_jumps"), F.coalesce(F.sum("step"), F.lit(0)).alias("total_jump"))


def sector_histogram(reads: DataFrame, n_sectors: int, buckets: int = 32) -> DataFrame:
    """(bucket, n_reads)"""
    return reads.groupBy(F.floor(F.col("sector") * buckets / n_sectors).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n_reads"))


def parent_or_self(requests: DataFrame) -> DataFrame:
    """(query_id, hop, parent, n_children, n_parent, n_self, use_parent) of requests(query_id, hop, parent, child, parent_sector, self_sector).

    One child wanted: the parent's extent is read. Several: it is read if it has fewer distinct
    sectors than the children's own places.
    """
    x = requests.groupBy("query_id", "hop", "parent").agg(F.countDistinct("child").alias("n_children"), F.countDistinct("parent_sector").alias("n_parent"), F.countDistinct("self_sector").alias("n_self"))
    return x.withColumn("use_parent", (F.col("n_children") < 2) | (F.col("n_parent") < F.col("n_self")))


def locate_replica(requests: DataFrame, replicas: DataFrame) -> DataFrame:
    """(query_id, parent, child, page, how) of requests(query_id, parent, child) on replicas(seed, page, node).

    The copy on the parent's own pages is first choice ("parent"), then the lowest page with a copy
    ("replica"), else none ("base").
    """
    x = requests.join(replicas, requests["child"] == replicas["node"], "left")
    order = Window.partitionBy("query_id", "parent", "child").orderBy(F.desc(F.col("seed").eqNullSafe(F.col("parent"))), F.col("page").asc_nulls_last())
    x = x.withColumn("n", F.row_number().over(order)).where("n = 1")
    how = F.when(F.col("page").isNull(), "base").when(F.col("seed") == F.col("parent"), "parent").otherwise("replica")
    return x.select("query_id", "parent", "child", "page", how.alias("how"))


def evicted(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (n_old, n_new, n_evicted, n_kept) of two cache lists (id)."""
    a, b = old.select("id").distinct(), new.select("id").distinct()
    kept = a.join(b, "id", "left_semi").agg(F.count(F.lit(1)).alias("n_kept"))
    return a.agg(F.count(F.lit(1)).alias("n_old")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("n_new")))).join(F.broadcast(kept)).select("n_old", "n_new", (F.col("n_old") - F.col("n_kept")).alias("n_evicted"), "n_kept")


def verify(cached: DataFrame, base: DataFrame) -> DataFrame:
    """Cached rows (id, vec, nbrs) that differ from the base's, or that it lacks."""
    x = cached.alias("c").join(base.alias("b"), F.col("c.id") == F.col("b.id"), "left")
    return x.where(~(F.col("c.vec").eqNullSafe(F.col("b.vec")) & F.col("c.nbrs").eqNullSafe(F.col("b.nbrs")))).select("c.id")
