"""Row numbers and running sums in an order of all rows, without a task that sees all of them.

Rows are dealt into ranges of the order (Spark samples it for even ranges), sorted within each and
written with their range and place in it. A count for each range, one row a task, then gives every
range the number of its first row. A window without a partition would bring all rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bits of monotonically_increasing_id() that number the rows of a partition; the ones above number partitions.
_ROW_BITS = 33


def numbered(df: DataFrame, *order: str | Column, place: str = "place", first: int = 1, before: str | None = None, value: Column | None = None) -> DataFrame:
    """df with the number of each row by `order`, from `first` on; the order must tell all rows apart.

    before: a column for the sum of `value` over all earlier rows, 0 for the first. The rows are
    written once, so every use of the result finds the same numbers.
    """
    names = df.columns
    value = F.lit(0) if value is None else value
    rows = df.withColumn("__numbered_value", value.cast("bigint")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("__numbered_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__numbered_range", F.shiftright("__numbered_at", _ROW_BITS))
    counts = rows.groupBy("__numbered_range").agg(F.count(F.lit(1)).alias("n"), F.sum("__numbered_value").alias("total"))
    starts, n, total = [], 0, 0
    for r in sorted(counts.collect()):  # a row for each range, as many as shuffle partitions
        starts.append((r["__numbered_range"], n, total))
        n, total = n + r.n, total + (r.total or 0)
    out = rows.join(F.broadcast(df.sparkSession.createDataFrame(starts, "__numbered_range bigint, __numbered_n bigint, __numbered_total bigint")), "__numbered_range")
    at = F.col("__numbered_n") + F.col("__numbered_at").bitwiseAND((1 << _ROW_BITS) - 1) + first
    columns = [*names, at.alias(place)]
    if before is not None:
        own = Window.partitionBy("__numbered_range").orderBy("__numbered_at").rowsBetween(Window.unboundedPreceding, -1)
        columns.append((F.col("__numbered_total") + F.coalesce(F.sum("__numbered_value").over(own), F.lit(0))).alias(before))
    return out.select(*columns)
