"""Index classes: build, open, search, labels, refusals; and the catalogue against DuckDB."""

import json
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridvane import catalogue
from gridvane.functions import vectors as fv
from gridvane.index import DiskIndex, StaticIndex, answer_json
from gridvane.operators import knn, metrics

from .conftest import SF


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(54321)
    x = rng.random((600, 10)).astype(np.float32)
    rows = [(i, v.tolist(), (["even_by_3"] if i % 3 == 0 else []) + (["even_by_5"] if i % 5 == 0 else []) or ["neither"]) for i, v in enumerate(x)]
    base = spark.createDataFrame(rows, "id bigint, vec array<float>, labels array<string>")
    return base, spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "query_id bigint, vec array<float>")


@pytest.mark.parametrize("kind", [StaticIndex, DiskIndex])
def test_build_open_search(spark, data, tmp_path, kind):
    base, queries = data
    kind.build(base.drop("labels"), str(tmp_path / "i"), degree=16, complexity=32)
    index = kind(spark, str(tmp_path / "i"))
    assert index.meta["points"] == 600 and index.meta["dims"] == 10 and index.meta["metric"] == "l2"
    found = index.search(queries, 5, 32).cache()
    assert metrics.recall_at_k(knn.exact(base, queries, 10), found, 5).first().recall > 90
    first = queries.first()
    ids, dists = index.search_one(first.vec, 5, 32)
    assert ids[0] == first.query_id and dists == sorted(dists)
    with pytest.raises(ValueError):
        index.search_one([1.0], 5, 32)
    with pytest.raises(ValueError):
        index.search(queries, 5, 32, "even_by_3")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert index.search(queries, 10, 4).count() == 400 and seen


@pytest.mark.parametrize("filter_complexity", [0, 32])
def test_labels(data, tmp_path, filter_complexity):
    base, queries = data
    index = StaticIndex.build(base, str(tmp_path / "l"), degree=12, complexity=32, filter_complexity=filter_complexity, universal_label="all")
    found = index.search(queries, 5, 32, "even_by_5").join(base, "id")
    assert found.count() == 200 and found.where(~F.array_contains("labels", "even_by_5")).count() == 0
    with pytest.raises(ValueError):
        index.search(queries, 5, 32, "none of them")
    lines = base.sparkSession.createDataFrame([(json.dumps({"query_id": 7, "query": queries.first().vec, "k": 3, "filter": "neither"}),), ("{",)], "value string")
    out = [json.loads(r.value) for r in answer_json(index, lines).collect()]
    assert len(out) == 2 and sum(len(o.get("indices", [])) for o in out) == 3


def test_refusals(data, tmp_path):
    base, _ = data
    for bad in ({"metric": "dot"}, {"dtype": "double"}, {"metric": "ip", "dtype": "int8"}, {"degree": 0}, {"complexity": -1}, {"alpha": 0.9}):
        with pytest.raises(ValueError):
            StaticIndex.build(base, str(tmp_path / "x"), **bad)


def test_quantised_types(data, tmp_path):
    base, _ = data
    x = base.drop("labels").withColumn("vec", F.transform("vec", lambda v: F.floor(v * 200).cast("smallint")))
    queries = x.where("id < 20").select(F.col("id").alias("query_id"), "vec")
    for metric in ("l2", "cosine"):
        index = StaticIndex.build(x, str(tmp_path / metric), metric=metric, dtype="uint8", degree=16, complexity=32)
        assert metrics.recall_at_k(knn.exact(x, queries, 10, metric), index.search(queries, 5, 32), 5).first().recall > 90


def test_vector_expressions(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "id bigint, vec array<double>")
    v = F.col("vec")
    got = rows.select("id", fv.norm(v).alias("n"), fv.cosine(v, v).alias("c"), fv.inner_product(v, v).alias("p"), fv.residual(v, F.array(F.lit(1.0), F.lit(1.0))).alias("r"), fv.mips_query(v).alias("q"), fv.dequantise_int8(fv.quantise_int8(v, 0, 254), 0, 1).alias("d")).collect()
    assert got[0].n == 5 and got[0].c == 0 and got[0].p == -25 and got[0].r == [2.0, 3.0] and got[0].q == [0.6, 0.8, 0.0] and got[0].d == [3.0, 4.0]
    assert np.isnan(got[1].c) and fv.normalise(rows).where("id = 1").first().vec == [0.0, 0.0]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_catalogue_like_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    if name in catalogue.ORACLE_SQL:
        c = con.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in c.description]
        assert sorted(names) == cols
        assert got == sorted(str(tuple(r[names.index(x)] for x in cols)) for r in c.fetchall())
    assert got


def test_entry(spark):
    n = catalogue.embeddings(spark, SF).where("id % 100 = 0").count()
    assert __spark_entry__.entry(spark).count() == 10 * n
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["vamana_search", "stitched_search", "range_search_graph"])
def test_searches_ask_every_hundredth_row(spark, name):
    n = catalogue.embeddings(spark, SF).where("id % 100 = 0").count()
    assert catalogue.QUERIES[name](spark, SF).first().n_queries == n


def test_lfu_pool_replays_all_edges(spark):
    got = catalogue.QUERIES["lfu_pool"](spark, SF).select("pool", "seq").collect()
    n = catalogue.embeddings(spark, SF).count()
    assert len(got) == len(set(got)) == 8 * n and len({r.pool for r in got}) > 8


def test_bfs_levels_beyond_eight(spark, monkeypatch):
    chain = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    monkeypatch.setattr(catalogue, "edges", lambda *_: chain)
    assert {r.level: r.n_nodes for r in catalogue.QUERIES["bfs_levels"](spark, SF).collect()} == {i: 1 for i in range(21)}
