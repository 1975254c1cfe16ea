"""Access profiles of graph search: counters, heat, thresholds, templates.

Tables: trace(query_id, hop, node_id, parent_id, event), edge_profile(u, v, cnt) and
node_profile(id, n_expand, n_visit, out_heat). A parent's children are ranked by (cnt descending,
id ascending) everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered


def node_counters(trace: DataFrame) -> DataFrame:
    """node_profile of a trace: expansions, visits, and credited edges that leave the node."""
    hits = trace.groupBy(F.col("node_id").alias("id")).agg(
        F.sum((F.col("event") == "expand").cast("bigint")).alias("n_expand"), F.sum((F.col("event") == "visit").cast("bigint")).alias("n_visit")
    )
    out = edge_counters(trace).groupBy(F.col("u").alias("id")).agg(F.sum("cnt").alias("out_heat"))
    x = hits.join(out, "id", "full_outer")
    return x.select("id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_expand", "n_visit", "out_heat")])


def edge_counters(trace: DataFrame) -> DataFrame:
    """edge_profile of a trace: an edge counts when its child is expanded, for the parent that first found it."""
    found = trace.where((F.col("event") == "expand") & F.col("parent_id").isNotNull())
    return found.groupBy(F.col("parent_id").alias("u"), F.col("node_id").alias("v")).agg(F.count(F.lit(1)).alias("cnt"))


def hop_templates(trace: DataFrame) -> DataFrame:
    """(nodes, weight): the distinct sets of nodes expanded in one hop, and how often each occurred."""
    sets = trace.where("event = 'expand'").groupBy("query_id", "hop").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    return sets.groupBy("nodes").agg(F.count(F.lit(1)).alias("weight"))


def live_edges(edge_profile: DataFrame, n: int | None = None) -> DataFrame:
    """Edges with a count above zero and both ends below n."""
    x = edge_profile.where("cnt > 0")
    return x.where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < n) & (F.col("v") < n)) if n is not None else x


def undirected_weights(edge_profile: DataFrame) -> DataFrame:
    """(u, v, weight) with u < v: the counts of both directions."""
    x = edge_profile.where("u <> v")
    return x.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("cnt").alias("weight"))


def out_heat(edge_profile: DataFrame) -> DataFrame:
    return edge_profile.groupBy(F.col("u").alias("id")).agg(F.sum("cnt").alias("heat"))


def in_heat(edge_profile: DataFrame) -> DataFrame:
    return edge_profile.groupBy(F.col("v").alias("id")).agg(F.sum("cnt").alias("heat"))


def children(edge_profile: DataFrame) -> DataFrame:
    """edge_profile with rn (rank among the parent's children), total and running count."""
    order = Window.partitionBy("u").orderBy(F.desc("cnt"), "v")
    x = live_edges(edge_profile).withColumn("rn", F.row_number().over(order).cast("bigint"))
    return x.withColumn("total", F.sum("cnt").over(Window.partitionBy("u"))).withColumn("running", F.sum("cnt").over(order))


def threshold(edge_profile: DataFrame, share: float, cap: int) -> DataFrame:
    """children() with n_children and k: how many are hot.

    k is the smallest rank whose running share reaches `share`, rounded up to fill its page; the first
    page holds cap - 1 children beside the parent, later ones cap.
    """
    x = children(edge_profile)
    of = Window.partitionBy("u")
    first = F.min(F.when(F.col("running") / F.col("total") >= share, F.col("rn"))).over(of)
    x = x.withColumn("n_children", F.count(F.lit(1)).over(of)).withColumn("k0", F.coalesce(first, F.col("n_children")))
    full = F.when(F.col("k0") <= cap - 1, F.lit(cap - 1)).otherwise(F.lit(cap - 1) + F.ceil((F.col("k0") - (cap - 1)) / cap) * cap)
    return x.withColumn("k", F.least(full, F.col("n_children")).cast("bigint")).drop("k0")


def page_of(rn, cap: int, seeded: bool = True):
    """Page of the rn-th node (from 1): with a seed the first page has room for cap - 1."""
    if not seeded:
        return F.floor((rn - 1) / cap)
    return F.when(rn <= cap - 1, F.lit(0)).otherwise(1 + F.floor((rn - cap) / cap)).cast("bigint")


def pages(edge_profile: DataFrame, cap: int) -> DataFrame:
    """(u, v, rn, page): all children of each parent on pages of cap slots, the parent on the first."""
    x = children(edge_profile)
    return x.select("u", "v", "rn", page_of(F.col("rn"), cap).alias("page"))


def benefit(edge_profile: DataFrame, share: float, cap: int) -> DataFrame:
    """(id, heat, n_pages, benefit): out-heat over the pages that the hot children need."""
    hot = threshold(edge_profile, share, cap).where(F.col("rn") <= F.col("k"))
    per = hot.groupBy(F.col("u").alias("id")).agg(F.max("total").alias("heat"), (F.max(page_of(F.col("rn"), cap)) + 1).alias("n_pages"))
    return per.withColumn("benefit", F.col("heat") / F.greatest(F.lit(1), F.col("n_pages")))


def top4_first(edge_profile: DataFrame) -> DataFrame:
    """(place, id, heat, covered): parents whose four hottest children take all their heat come first, then by heat."""
    x = children(edge_profile).groupBy(F.col("u").alias("id")).agg(F.max("total").alias("heat"), F.sum(F.when(F.col("rn") <= 4, F.col("cnt")).otherwise(0)).alias("top4"))
    x = x.withColumn("covered", F.col("top4") == F.col("heat"))
    return numbered(x, F.desc("covered"), F.desc("heat"), "id").select("place", "id", "heat", "covered")


def edge_templates(edge_profile: DataFrame, beam: int) -> DataFrame:
    """(nodes, weight): each parent's `beam` hottest children as a set, with their counts; like sets are added."""
    hot = children(edge_profile).where(F.col("rn") <= max(1, beam))
    sets = hot.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("nodes"), F.sum("cnt").alias("weight"))
    return sets.groupBy("nodes").agg(F.sum("weight").alias("weight"))


def eligible_templates(templates: DataFrame, eligible: DataFrame) -> DataFrame:
    """Templates cut to eligible(id) nodes; those of at least two distinct nodes stay, like sets are added."""
    x = templates.withColumn("t", F.monotonically_increasing_id()).select("t", "weight", F.explode(F.array_distinct("nodes")).alias("id"))
    x = x.join(eligible.select("id"), "id", "left_semi").groupBy("t", "weight").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return x.where(F.size("nodes") >= 2).groupBy("nodes").agg(F.sum("weight").alias("weight"))


def top_templates(templates: DataFrame, n: int) -> DataFrame:
    return templates.orderBy(F.desc("weight"), "nodes").limit(n)


def cooccurrence(templates: DataFrame) -> DataFrame:
    """(u, v, weight) with u < v: summed weight of the templates that hold both; a template has `beam` nodes at most."""
    pair = F.flatten(F.transform("nodes", lambda a: F.transform(F.filter("nodes", lambda b: b > a), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    x = templates.select(F.explode(pair).alias("p"), "weight")
    return x.groupBy(F.col("p.u").alias("u"), F.col("p.v").alias("v")).agg(F.sum("weight").alias("weight"))


def sweep_cut(edge_profile: DataFrame, seed_share: float, child_share: float) -> DataFrame:
    """(u, v): the hottest share of parents with the hottest share of each one's children, rounded up."""
    heat = out_heat(edge_profile)
    heat = numbered(heat, F.desc("heat"), "id")
    heat = heat.join(F.broadcast(heat.agg(F.count(F.lit(1)).alias("n"))))
    seeds = heat.where(F.col("place") <= F.ceil(F.col("n") * seed_share)).select(F.col("id").alias("u"))
    x = children(edge_profile).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("u")))
    return x.where(F.col("rn") <= F.ceil(F.col("n") * child_share)).join(seeds, "u", "left_semi").select("u", "v")
