"""Numbers and running sums over ranges against a plain sort."""

import pytest
from pyspark.sql import functions as F

from gridvane.plans.numbering import numbered


@pytest.mark.parametrize("n,hot", [(0, 3), (1, 3), (5000, 3), (5000, 1)])
def test_like_a_sort(spark, n, hot):
    """hot: every hot-th row shares one key, so the ranges must cut by the second column."""
    rows = spark.range(n).select("id", F.when(F.col("id") % hot == 0, 7).otherwise(F.col("id") % 50).alias("key"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 4).alias("size"), F.lit("x").alias("n"))
    got = numbered(rows, F.desc("key"), "id", place="at", first=0, before="before", value=F.coalesce("size", F.lit(0))).orderBy("at").collect()
    want = sorted(rows.collect(), key=lambda r: (-r.key, r.id))
    assert [tuple(r)[:4] for r in got] == [tuple(r) for r in want] and [r["at"] for r in got] == list(range(n))
    total = 0
    for r in got:
        assert r.before == total
        total += r.size or 0


def test_no_task_sees_all_rows(spark):
    """Spark joins small ranges unless it is told not to."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = spark.range(20_000).select("id", (F.col("id") % 2).alias("key"))
        out = numbered(rows, "key", "id")
        written = out._jdf.inputFiles()
        assert len(written) > 1
        for plan in (out, numbered(rows, "key", "id", before="b", value=F.lit(1))):
            assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
        assert out.where("place <> 1 + id div 2 + key * 10000").count() == 0
    finally:
        spark.conf.set(name, before)
