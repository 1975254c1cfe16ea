"""What a routed search moves and sorts of its candidates."""

from gridvane import catalogue
from gridvane.operators import routed

from .conftest import SF


def test_candidates_are_not_sorted_beside_their_query(spark, tmp_path):
    base = catalogue.embeddings(spark, SF)
    index = routed.RoutedIndex.build(base, str(tmp_path / "index"), degree=8, complexity=16, shard_size=250, pq_chunks=8)
    queries = catalogue.asked(base)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = index.search(queries, 5, 60, index.meta["shards"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [id#" in plan  # by id with the vectors: a sort would spill each candidate with its query
    assert "vec" not in routed._WALKED
    assert len(rows) == 5 * queries.count() == len({(r.query_id, r.id) for r in rows})
    assert all(r.id == r.query_id for r in rows if r["rank"] == 1)
