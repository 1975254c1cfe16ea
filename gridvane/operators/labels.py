"""Label files, encoding, statistics and dense points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered


def parse_lines(lines: DataFrame) -> DataFrame:
    """(id, labels): lines(id, line) hold comma separated labels, up to a tab; carriage returns and blanks go."""
    text = F.regexp_replace(F.element_at(F.split("line", "\t"), 1), r"[\r\n]", "")
    return lines.select("id", F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "").alias("labels"))


def encode(points: DataFrame, universal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with label ids, label_dict(label, label_id)): the universal label is 0, others count from 1 as they first appear.

    Without it numbers start at 1 as well. Order of appearance is (id, place in the list).
    """
    seen = points.select("id", F.posexplode("labels").alias("place", "label"))
    first = seen.groupBy("label").agg(F.min(F.struct("id", "place")).alias("at"))
    others = first.where(F.col("label") != universal) if universal is not None else first
    table = numbered(others, "at", place="label_id").select("label", "label_id")
    if universal is not None:
        table = table.unionByName(points.sparkSession.createDataFrame([(universal, 0)], "label string, label_id bigint"))
    coded = seen.join(table, "label").groupBy("id").agg(F.sort_array(F.collect_list("label_id")).alias("labels"))
    return coded, table


def convert(queries: DataFrame, table: DataFrame, universal_id: int | None = None) -> DataFrame:
    """queries(query_id, label) with label_id; an unknown label becomes the universal one, or an error without one."""
    x = queries.join(table, "label", "left")
    if universal_id is not None:
        return x.withColumn("label_id", F.coalesce("label_id", F.lit(universal_id).cast("bigint")))
    return x.withColumn("label_id", F.when(F.col("label_id").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), "label"))).otherwise(F.col("label_id")))


def expand_universal(points: DataFrame, universal: int) -> DataFrame:
    """(id, label) pairs, where a point with the universal label has all labels."""
    pairs = points.select("id", F.explode("labels").alias("label"), F.array_contains("labels", universal).alias("everywhere"))
    every = pairs.select("label").distinct().where(F.col("label") != universal)
    # labels are few beside points; each universal point meets the list of them
    listed = every.agg(F.sort_array(F.collect_list("label")).alias("every"))
    wide = pairs.where("everywhere").select("id").distinct().join(F.broadcast(listed)).select("id", F.explode("every").alias("label"))
    return pairs.where("not everywhere").select("id", "label").unionByName(wide).distinct()


def label_counts(points: DataFrame) -> DataFrame:
    """(label, n_points)"""
    return points.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_points"))


def statistics(points: DataFrame, density: int) -> DataFrame:
    """One row: points, labels, share of points with at least `density` labels, mean labels a point, mean points a label."""
    per = points.agg(F.count(F.lit(1)).alias("n_points"), F.avg((F.size("labels") >= density).cast("double")).alias("dense_share"), F.sum(F.size("labels").cast("bigint")).alias("pairs"))
    counts = label_counts(points).agg(F.count(F.lit(1)).alias("n_labels"))
    one = per.join(F.broadcast(counts))  # one row each
    return one.select("n_points", "n_labels", "dense_share", F.try_divide("pairs", "n_points").alias("labels_per_point"), F.try_divide("pairs", "n_labels").alias("points_per_label"))


def top_labels(points: DataFrame, n: int = 3) -> DataFrame:
    """(place, label, n_points) of the n most frequent labels."""
    top = label_counts(points).orderBy(F.desc("n_points"), "label").limit(n)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n_points")).alias("order"), "label", "n_points"))).alias("rows"))  # n rows
    return listed.select(F.posexplode("rows").alias("at", "row")).select((F.col("at") + 1).cast("bigint").alias("place"), "row.label", "row.n_points")


def split_dense(points: DataFrame, density: int) -> DataFrame:
    """(id, real_id, labels): a point with more than `density` labels is cut into copies with so many each.

    The first copy keeps the id; further ones get new ids after the largest, in order of (id, part).
    """
    labels = F.sort_array("labels")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("labels") / density).cast("int") - 1)), lambda p: F.slice(labels, p * density + 1, density))
    x = points.select("id", F.posexplode(parts).alias("part", "labels"))
    extra = numbered(x.where("part > 0"), "id", "part", place="n")
    top = points.agg(F.max("id").alias("top"))
    extra = extra.join(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), F.col("id").alias("real_id"), "labels")
    return x.where("part = 0").select("id", F.col("id").alias("real_id"), "labels").unionByName(extra)


def overlap(labels: Column, wanted: int, universal: int | None = None) -> Column:
    """The search predicate: the point has the label or the universal one."""
    has = F.array_contains(labels, wanted)
    return has | F.array_contains(labels, universal) if universal is not None else has


def build_overlap(a: Column, b: Column, universal: int | None = None) -> Column:
    """The build predicate: a common label, or the universal one on either side."""
    both = F.arrays_overlap(a, b)
    return both | F.array_contains(a, universal) | F.array_contains(b, universal) if universal is not None else both


#: Points that one task labels at once.
BLOCK = 65_536


def zipf_quota(n: int, label: int) -> int:
    """How many of n points have a label, counted from 1: 0.7 n over its number, rounded as integers are."""
    return -(-7 * n // 10) // label


def synthetic(spark, n: int, n_labels: int, kind: str, seed: int = 0) -> DataFrame:
    """(id, labels) of n points: kind is zipf (exactly zipf_quota points for each label), random (each label on half) or one_per_point.

    A block of points has the share of each quota that falls on it, floor(q end / n) - floor(q begin / n),
    which add up to the quota; within the block the points are drawn without repetition. A point
    without a label has 0.
    """
    luck = lambda *c: F.shiftrightunsigned(F.xxhash64(*c, F.lit(seed)), 11) / float(1 << 53)
    rows = spark.range(n)
    if kind == "one_per_point":
        return rows.select("id", F.array(F.floor(luck("id") * (n_labels + 1)).cast("int")).alias("labels"))
    if kind == "random":
        got = F.filter(F.sequence(F.lit(1), F.lit(n_labels)), lambda x: luck(F.col("id"), x) < 0.5)
        return rows.select("id", F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(0))).alias("labels"))
    if kind != "zipf":
        raise ValueError("kind must be zipf, random or one_per_point")

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                a, z = block * BLOCK, min(n, (block + 1) * BLOCK)
                rng = np.random.default_rng([seed, block])
                points, labels = [], []
                for label in range(1, n_labels + 1):
                    q = zipf_quota(n, label)
                    k = q * z // n - q * a // n
                    points.append(rng.choice(z - a, k, replace=False))
                    labels.append(np.full(k, label))
                points, labels = np.concatenate(points or [np.zeros(0, np.int64)]), np.concatenate(labels or [np.zeros(0, np.int64)])
                none = np.setdiff1d(np.arange(z - a), points)
                points, labels = np.append(points, none), np.append(labels, np.zeros(len(none), np.int64))
                order = np.lexsort((labels, points))
                ends = np.cumsum(np.bincount(points, minlength=z - a))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(labels[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, z)), lists], ["id", "labels"])

    blocks = -(-n // BLOCK)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, "id bigint, labels array<int>")
