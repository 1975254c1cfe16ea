"""Recall, percentiles, norms and statistics of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..functions.vectors import norm


def _tied_truth(truth: DataFrame, k: int, count: Column | None = None) -> DataFrame:
    """The truth rows that count for k: the first k, and those as near as the k-th."""
    order = Window.partitionBy("query_id").orderBy("rank")
    nth = F.sum(count).over(order) if count is not None else F.col("rank")
    x = truth.withColumn("nth", nth)
    kth = F.max(F.when((F.col("nth") <= k) & (count == 1 if count is not None else F.lit(True)), F.col("distance"))).over(Window.partitionBy("query_id"))
    return x.withColumn("kth", kth).where((F.col("nth") <= k) | (F.col("distance") == F.col("kth")))


def recall_at_k(truth: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """One row (recall, n_queries): percent of the k nearest found, where truth rows that tie with the k-th count too.

    truth and results: (query_id, rank, id, distance) with ranks from 1. Raises ValueError when k is
    larger than what either has.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    wanted = _tied_truth(truth, k).select("query_id", "id")
    found = results.where(F.col("rank") <= k).select("query_id", "id").join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    per = truth.select("query_id").distinct().join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return per.agg((F.try_divide(F.sum("found") * 100.0, F.count(F.lit(1))) / k).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def recall_active(truth: DataFrame, results: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """recall_at_k where only truth rows with an id in active(id) count: the first k active ones, and ties."""
    marked = truth.join(active.select("id", F.lit(1).alias("live")), "id", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    wanted = _tied_truth(marked, k, F.col("live")).where("live = 1").select("query_id", "id")
    found = results.where(F.col("rank") <= k).select("query_id", "id").join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    per = truth.select("query_id").distinct().join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return per.agg((F.try_divide(F.sum("found") * 100.0, F.count(F.lit(1))) / k).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def range_recall(queries: DataFrame, truth: DataFrame, results: DataFrame) -> DataFrame:
    """Mean over queries(query_id) of the percent of truth(query_id, id) found; 100 where there is none."""
    size = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    found = truth.join(results.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    per = queries.select("query_id").join(size, "query_id", "left").join(found, "query_id", "left")
    each = F.when(F.col("size").isNull(), 100.0).otherwise(F.coalesce("found", F.lit(0)) * 100.0 / F.col("size"))
    return per.agg(F.avg(each).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def percentile_at(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., share, value): the sorted value at index floor(share * n), counted from 0, the last at most."""
    if by:
        x = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1)
    else:
        by = []
        x = numbered(rows, value, place="__at", first=0)
        x = x.join(F.broadcast(x.agg(F.count(F.lit(1)).alias("__n"))))
    x = x.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    index = F.least(F.floor(F.col("share") * F.col("__n")), F.col("__n") - 1)
    return x.where(F.col("__at") == index).select(*by, "share", F.col(value).alias("value"))


def norm_percentiles(vectors: DataFrame, step: int = 5) -> DataFrame:
    """(share, value): norms at every `step` percent, the largest at 100."""
    norms = vectors.select(norm(F.col("vec")).alias("norm"))
    return percentile_at(norms, "norm", [p / 100 for p in range(0, 101, step)])


def count_profile(counts: DataFrame, column: str) -> DataFrame:
    """(percent, value) of the non-zero counts, largest first, at index floor(p (n - 1) / 100)."""
    x = numbered(counts.where(F.col(column) > 0).select(column), F.desc(column), place="at", first=0)
    x = x.join(F.broadcast(x.agg(F.count(F.lit(1)).alias("n"))))
    x = x.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)])))
    return x.where(F.col("at") == F.floor(F.col("percent") * (F.col("n") - 1) / 100)).select(F.col("percent").cast("bigint").alias("percent"), F.col(column).alias("value"))


def mean_stats(stats: DataFrame, *columns: str) -> DataFrame:
    return stats.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def simulate_aggregate_recall(spark, k: int, parts: int, recalls: list[float], runs: int, seed: int = 0) -> DataFrame:
    """Expected recall when k neighbours fall on `parts` indexes at random, each of which finds recalls[count - 1] of its own.

    One row (recall, runs); partitions without a neighbour are left out.
    """
    rows = spark.range(runs).select("id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    part = F.pmod(F.xxhash64("id", "i", F.lit(seed)), F.lit(parts))
    per = rows.groupBy("id", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    rate = F.element_at(F.array(*[F.lit(float(r)) for r in recalls]), F.least("n", F.lit(len(recalls))).cast("int"))
    return per.agg((F.sum(rate * F.col("n")) / (F.lit(runs) * k)).alias("recall")).withColumn("runs", F.lit(runs))
