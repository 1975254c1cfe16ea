"""Synthetic vectors, samples, query mixes over graph regions, and what a layout captures of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .graph import bfs


def luck(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / float(1 << 53)


def random_vectors(spark: SparkSession, n: int, dim: int, dtype: str = "float", seed: int = 0, norm: float | None = None) -> DataFrame:
    """(id, vec): normal components for float (scaled to `norm` if given), even ones over the range for int8 and uint8."""
    places = F.sequence(F.lit(1), F.lit(dim))
    one = lambda i: luck(seed, F.col("id"), i)
    if dtype == "float":
        two = lambda i: luck(seed + 1, F.col("id"), i)
        v = F.transform(places, lambda i: F.sqrt(-2 * F.ln(1 - one(i))) * F.cos(2 * 3.141592653589793 * two(i)))
        rows = spark.range(n).withColumn("vec", v)
        if norm is not None:
            length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
            rows = rows.withColumn("vec", F.transform("vec", lambda x: F.try_divide(x, length) * norm))
        return rows.withColumn("vec", F.col("vec").cast("array<float>"))
    if dtype == "int8":
        return spark.range(n).withColumn("vec", F.transform(places, lambda i: (F.floor(one(i) * 256) - 128).cast("tinyint")))
    if dtype == "uint8":
        return spark.range(n).withColumn("vec", F.transform(places, lambda i: F.floor(one(i) * 256).cast("smallint")))
    raise ValueError("dtype must be float, int8 or uint8")


def hash_sample(rows: DataFrame, share: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """A Bernoulli sample that is the same at every run."""
    return rows.where(luck(seed, F.col(id_col)) < share)


def region(edges: DataFrame, start: int, size: int) -> DataFrame:
    """(id, level): the `size` nodes nearest to a start by hops, ties by id."""
    spark = edges.sparkSession
    found = bfs(edges, spark.createDataFrame([(start,)], "id bigint"))
    return found.orderBy("level", "id").limit(size)


def farthest(edges: DataFrame, start: int) -> DataFrame:
    """One row (id): the node most hops away from a start, the smallest of equals; one that is never reached comes first."""
    spark = edges.sparkSession
    found = bfs(edges, spark.createDataFrame([(start,)], "id bigint"))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    x = nodes.join(found, "id", "left")
    return x.orderBy(F.col("level").desc_nulls_first(), "id").select("id").limit(1)


#: Shares of region x, of region y and of all nodes from which a mix draws its queries, in turn.
MIXES = {"uniform": (0.0, 0.0, 1.0), "x_only": (1.0, 0.0, 0.0), "y_only": (0.0, 1.0, 0.0), "mostly_x": (0.8, 0.0, 0.2), "mostly_y": (0.0, 0.8, 0.2), "both": (0.5, 0.5, 0.0)}


def query_mix(vectors: DataFrame, x: DataFrame, y: DataFrame, n: int, mix: str, seed: int = 42) -> DataFrame:
    """(query_id, vec, source): n queries drawn from regions x(id) and y(id) and from all vectors; "x_then_y" asks x first.

    Each source gives exactly its share of n. A region that is large enough gives different points, by
    the smallest hashes; a smaller one, and the draw from all vectors, may give a point again.
    """
    if mix == "x_then_y":
        a, b = (query_mix(vectors, x, y, k, m, seed) for k, m in ((n - n // 2, "x_only"), (n // 2, "y_only")))
        return a.unionByName(b.withColumn("query_id", F.col("query_id") + (n - n // 2)))
    if mix not in MIXES:
        raise ValueError(f"mix must be x_then_y or one of {sorted(MIXES)}")
    a, b, _ = MIXES[mix]
    cuts = [0, round(a * n), round((a + b) * n), n]
    asked = None
    for i, (pool, name) in enumerate(((x, "x"), (y, "y"), (vectors, "all"))):
        first, k = cuts[i], cuts[i + 1] - cuts[i]
        size = pool.count() if k else 0
        if not size:
            if k:
                raise ValueError(f"there is no point to draw {k} queries from")
            continue
        rows = numbered(pool.select("id").withColumn("at", luck(seed + i, F.col("id"))), "at", "id", place="place", first=0)
        if name != "all" and size >= k:
            got = rows.where(F.col("place") < k).select((F.col("place") + first).alias("query_id"), "id")
        else:
            picks = vectors.sparkSession.range(first, first + k).select(F.col("id").alias("query_id"), F.floor(luck(seed + 3, F.col("id")) * size).alias("place"))
            got = picks.join(rows, "place").select("query_id", "id")
        got = got.withColumn("source", F.lit(name))
        asked = got if asked is None else asked.unionByName(got)
    return asked.join(vectors.select("id", "vec"), "id").select("query_id", "vec", "source")


def page_capture(trace: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: how many expanded nodes of a trace lie on pages(seed, id) at all, and on pages of their parent.

    trace(query_id, hop, node_id, parent_id, event) as in operators.profile.
    """
    expanded = trace.where("event = 'expand'")
    on = pages.select(F.col("id").alias("node_id"), F.lit(1).alias("on")).distinct()
    near = pages.select(F.col("seed").alias("parent_id"), F.col("id").alias("node_id"), F.lit(1).alias("near")).distinct()
    x = expanded.join(on, "node_id", "left").join(near, ["parent_id", "node_id"], "left")
    return x.agg(F.count(F.lit(1)).alias("n_expanded"), F.count("on").alias("n_cached"), F.count("near").alias("n_with_parent"))


def heat_mass(node_profile: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: expansions of all nodes, and of those in listed(id)."""
    x = node_profile.join(listed.select("id", F.lit(1).alias("on")).distinct(), "id", "left")
    return x.agg(F.sum("n_expand").alias("heat"), F.coalesce(F.sum(F.when(F.col("on") == 1, F.col("n_expand"))), F.lit(0)).alias("heat_listed"))


def layout_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n_a, n_b, n_both) of two node lists."""
    x = a.select("id", F.lit(1).alias("a")).distinct().join(b.select("id", F.lit(1).alias("b")).distinct(), "id", "full_outer")
    return x.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("bigint")).alias("n_both"))
