"""Tables of the shared folder go when the step that made them is over."""

import os

import pytest
from pyspark.sql import functions as F

from gridvane.index import RoutedIndex
from gridvane.plans.numbering import numbered
from gridvane.plans.tables import scratch, settled, shared_folder, written
from gridvane.streaming.dynamic import DynamicIndex


def held(spark):
    folder = shared_folder(spark).removeprefix("file:") + "/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scratch(spark, tmp_path):
    outside = written(spark.range(5))
    before = held(spark)
    with scratch(spark):
        rows = numbered(spark.range(100), F.desc("id"))
        with scratch(spark):
            inner = written(spark.range(3))
            assert inner.count() == 3
        assert len(held(spark) - before) == 1
        rows.write.parquet(str(tmp_path / "out"))
    assert held(spark) == before and outside.count() == 5 and spark.read.parquet(str(tmp_path / "out")).count() == 100
    with pytest.raises(ZeroDivisionError):
        with scratch(spark):
            written(spark.range(1))
            1 / 0
    assert held(spark) == before
    kept = settled(spark, lambda: numbered(written(spark.range(10)), "id"))
    assert len(held(spark) - before) == 1 and kept.where("place = id + 1").count() == 10


def test_indexes_leave_no_tables(spark, tmp_path):
    base = spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.xxhash64("id", i).cast("float") / float(1 << 62)).alias("vec"))
    before = held(spark)
    index = RoutedIndex.build(base, str(tmp_path / "r"), degree=8, complexity=16, shard_size=150, pq_chunks=6)
    dynamic = DynamicIndex(spark, str(tmp_path / "d"), degree=8, width=16)
    dynamic.insert(base.where("id between 1 and 200"))
    dynamic.insert(base.where("id > 200"))
    dynamic.delete(base.where("id % 10 = 0").select("id"))
    assert dynamic.consolidate().first().n_freed == 29
    assert held(spark) == before
    ask = base.where("id % 50 = 1").select(F.col("id").alias("query_id"), "vec")
    assert index.search(ask, 1, 40, index.meta["shards"]).where("query_id = id").count() == 6
    assert dynamic.search(ask, 1, 40).where("query_id = id").count() == 6
