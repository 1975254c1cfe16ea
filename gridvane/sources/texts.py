"""Text forms: TSV vectors, label lines, truth tables, JSON queries and answers, CSV statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import SPARK_ELEMENT

QUERY_SCHEMA = "query_id bigint, query array<double>, k int, Ls int, filter string"
DEFAULT_WIDTH = 100


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line) of a text file, numbered as they stand in it from 0.

    Lines of a partition are numbered within it; the partitions' sizes, one number each, give offsets.
    """
    rows = spark.read.text(path).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    sizes = {r.p: r.size for r in rows.groupBy("p").agg(F.count(F.lit(1)).alias("size")).collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not offsets:
        return rows.select(F.lit(0).cast("bigint").alias("id"), "line")
    start = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o).cast("bigint"))])
    return rows.select((F.element_at(start, F.col("p")) + F.col("n").bitwiseAND((1 << 33) - 1)).alias("id"), "line")


def read_tsv(spark: SparkSession, path: str, dtype: str = "float") -> DataFrame:
    """(id, vec): one vector a line, values apart by tabs."""
    kind = SPARK_ELEMENT[dtype]
    return numbered_lines(spark, path).select("id", F.transform(F.split("line", "\t"), lambda x: x.cast("double").cast(kind)).alias("vec"))


def write_tsv(vectors: DataFrame, path: str) -> None:
    """One vector a line in order of id, in part files."""
    x = vectors.repartitionByRange("id").sortWithinPartitions("id")
    x.select(F.array_join(F.col("vec").cast("array<string>"), "\t").alias("value")).write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, labels) of a label file."""
    from ..operators.labels import parse_lines

    return parse_lines(numbered_lines(spark, path))


def truth_long(wide: DataFrame) -> DataFrame:
    """(query_id, rank, id, distance) of rows (query_id, ids, distances); distances may be null."""
    x = wide.select("query_id", F.posexplode("ids").alias("n", "id"), "distances")
    return x.select("query_id", (F.col("n") + 1).cast("bigint").alias("rank"), "id", F.try_element_at("distances", F.col("n") + 1).cast("double").alias("distance"))


def truth_wide(truth: DataFrame) -> DataFrame:
    """(query_id, ids, distances) in order of rank."""
    x = truth.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("r"))
    return x.select("query_id", F.transform("r", lambda s: s["id"]).alias("ids"), F.transform("r", lambda s: s["distance"]).alias("distances"))


def parse_queries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries(query_id, vec, k, width, label), errors(query_id, error)) of JSON lines(value).

    The list width Ls is 100 where it is missing. Rejected are unreadable lines, empty vectors, k
    below 1 and k above Ls.
    """
    x = lines.select("value", F.from_json("value", QUERY_SCHEMA).alias("j")).select("value", "j.*").withColumn("Ls", F.coalesce("Ls", F.lit(DEFAULT_WIDTH)))
    error = (
        F.when(F.col("query").isNull() | (F.size("query") == 0), "query is missing or empty")
        .when(F.col("k").isNull() | (F.col("k") <= 0), "k must be positive")
        .when(F.col("k") > F.col("Ls"), "Ls must be at least k")
    )
    x = x.withColumn("error", error)
    return (
        x.where("error is null").select("query_id", F.col("query").alias("vec"), "k", F.col("Ls").alias("width"), F.col("filter").alias("label")),
        x.where("error is not null").select("query_id", "error"),
    )


def _field(rows: str, name: str):
    return F.transform(rows, lambda s: s[name])


def answers_json(results: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(value): one JSON object a query with indices, distances (and tags, partition where given), or an error."""
    more = [c for c in ("tag", "partition") if c in results.columns]
    x = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance", *more))).alias("r"))
    fields = {"indices": "id", "distances": "distance", "tags": "tag", "partition": "partition"}
    out = x.select(F.to_json(F.struct("query_id", F.size("r").alias("k"), *[_field("r", c).alias(n) for n, c in fields.items() if c in ("id", "distance", *more)])).alias("value"))
    if errors is None:
        return out
    return out.unionByName(errors.select(F.to_json(F.struct("query_id", "error")).alias("value")))


def write_csv(rows: DataFrame, path: str) -> None:
    """Statistics or traces as CSV with a header; arrays as text."""
    flat = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def save_tables(path: str, tables: dict[str, DataFrame], meta: dict) -> None:
    """An index as a folder of Parquet tables and meta (dtype, metric, points, dims, ...), itself a one-line text."""
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, meta
