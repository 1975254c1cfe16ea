"""Shards of a search go to tasks of their own, and their searches in step."""

import pytest

from gridvane import catalogue
from gridvane.operators import kernels, vamana
from gridvane.plans.tables import written

from .conftest import SF


def test_shards_have_tasks_of_their_own(spark):
    rows = spark.range(0, 40).selectExpr("cast(id % 20 as int) as shard", "id")
    per = vamana._dealt(rows, 20).selectExpr("spark_partition_id() as p", "shard").distinct().groupBy("p").count()
    assert {r["count"] for r in per.collect()} == {1}


@pytest.mark.parametrize("universal", [None, 99])
def test_a_plain_search_by_label_is_in_step(spark, universal):
    base = catalogue.labelled(spark, SF)
    index = written(vamana.build(base, 16, 30, filtered=True))
    table = index.selectExpr("*", "false as dead").toArrow()
    block = [r.asDict() for r in catalogue.asked(base, "label").collect()]
    own, kernels.greedy_search = kernels.greedy_search, None  # the search by itself is not needed
    try:
        found = vamana._searcher(block, True, 10, 50, "l2", universal, None, 1, 0, None, False)(table)
    finally:
        kernels.greedy_search = own
    assert found.schema.names == ["query_id", "id", "distance", "hops", "n_compared", "n_ios"]
    stats = [r for r in found.to_pylist() if r["id"] is None]
    assert len(stats) == len(block) and all(r["hops"] > 0 and r["distance"] is None for r in stats)
    labels = {r.id: set(r.labels) for r in base.select("id", "labels").collect()}
    asked = {r["query_id"]: r["label"] for r in block}
    assert all(asked[r["query_id"]] in labels[r["id"]] or universal in labels[r["id"]] for r in found.to_pylist() if r["id"] is not None)
