"""Insert, delete and consolidate as table operations, and the sliding active window.

An index is a set of tables: points(id, vec), edges(src, dst) and tombstones(id). Steps return new
tables; streaming.dynamic keeps them as numbered versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered


def insert_new(points: DataFrame, rows: DataFrame, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with the accepted rows, rejected(id, reason)).

    Rejected are id 0 ("reserved"), ids that exist or repeat ("duplicate"), and, beyond the capacity,
    what comes last by id ("full").
    """
    x = rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.monotonically_increasing_id())))
    x = x.join(points.select("id", F.lit(True).alias("__there")), "id", "left")
    reason = F.when(F.col("id") == 0, "reserved").when(F.col("__there") | (F.col("__n") > 1), "duplicate")
    x = x.withColumn("reason", reason)
    if capacity is not None:
        room = points.agg(F.greatest(F.lit(0), F.lit(capacity) - F.count(F.lit(1))).alias("__room"))
        new = numbered(x.where("reason is null"), "id", "__n", place="__place").join(F.broadcast(room))
        new = new.withColumn("reason", F.when(F.col("__place") > F.col("__room"), "full"))
        x = x.where("reason is not null").unionByName(new.select(*x.columns))
    return points.unionByName(x.where("reason is null").select(*points.columns)), x.where("reason is not null").select("id", "reason")


def lazy_delete(points: DataFrame, tombstones: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones with the ids that exist, failed(id): unknown ones and those deleted before)."""
    live = points.select("id").join(tombstones, "id", "left_anti")
    wanted = ids.select("id").distinct()
    return tombstones.select("id").unionByName(wanted.join(live, "id", "left_semi")), wanted.join(live, "id", "left_anti")


def delete_candidates(edges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(src, dst) of the live nodes after deletion: a dead neighbour is replaced by its live neighbours."""
    dead = tombstones.select(F.col("id").alias("dst"))
    from_live = edges.select("src", "dst").join(dead.withColumnRenamed("dst", "src"), "src", "left_anti")
    keep = from_live.join(dead, "dst", "left_anti").select("src", "dst")
    via = from_live.join(dead, "dst", "left_semi").select("src", F.col("dst").alias("mid"))
    second = edges.select(F.col("src").alias("mid"), F.col("dst")).join(dead, "dst", "left_anti")
    more = via.join(second, "mid").where("src <> dst").select("src", "dst")
    return keep.unionByName(more).distinct()


def consolidate_report(points: DataFrame, edges: DataFrame, tombstones: DataFrame, capacity: int) -> DataFrame:
    """One row: status, live and freed points, points whose neighbours change, free places afterwards."""
    dead = tombstones.select("id").distinct()
    n = points.agg(F.count(F.lit(1)).alias("n_points"))
    freed = points.join(dead, "id", "left_semi").agg(F.count(F.lit(1)).alias("n_freed"))
    hit = edges.join(dead.withColumnRenamed("id", "dst"), "dst", "left_semi").join(dead.withColumnRenamed("id", "src"), "src", "left_anti")
    hit = hit.agg(F.countDistinct("src").alias("n_relinked"))
    one = n.join(F.broadcast(freed)).join(F.broadcast(hit))
    live = F.col("n_points") - F.col("n_freed")
    return one.select(F.lit("SUCCESS").alias("status"), live.alias("n_live"), "n_freed", "n_relinked", (F.lit(capacity) - live).alias("n_free"))


def check_window(active: int, interval: int, total: int) -> None:
    """Raises ValueError for parameters that a sliding window cannot have."""
    if active <= 0 or interval <= 0:
        raise ValueError("window and interval must be positive")
    if interval > active:
        raise ValueError("the interval must not exceed the window")
    if active + interval > total:
        raise ValueError("there must be more points than window and interval")


def window_live(positions: DataFrame, active: int, interval: int, total: int) -> DataFrame:
    """(step, position): what is live after each step.

    Positions come in order; the first `active` are there at the start, step s (active, active +
    interval, ...) adds [s, s + interval) and leaves [s - active, s + interval).
    """
    check_window(active, interval, total)
    steps = F.sequence(F.lit(active), F.lit((total - 1 - active) // interval * interval + active), F.lit(interval))
    live = F.filter(steps, lambda s: (F.col("position") >= s - active) & (F.col("position") < s + interval))
    return positions.select(F.explode(F.transform(live, lambda s: s.cast("bigint"))).alias("step"), F.col("position"))
