"""Files and texts: round trips and refusals."""

import collections
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridvane.operators import labels, workloads
from gridvane.sources import texts, truth, vectors


@pytest.mark.parametrize("kind,dtype", [("vecbin", "float"), ("vecbin", "int8"), ("vecbin", "uint8"), ("vecs", "float"), ("vecs", "uint8"), ("vecs", "int32")])
def test_round_trip(spark, tmp_path, kind, dtype):
    rng = np.random.default_rng(1)
    x = rng.random((300, 7)).astype(np.float32) if dtype == "float" else rng.integers(-128 if dtype == "int8" else 0, 127 if dtype == "int8" else 255, (300, 7))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id bigint, vec array<{vectors.KINDS[dtype][1]}>")
    path = str(tmp_path / "x")
    vectors.write(rows.repartition(5), path, dtype, kind)
    back = vectors.read(spark, path, dtype, kind).orderBy("id").collect()
    assert [r.id for r in back] == list(range(300)) and np.array_equal(np.array([r.vec for r in back]), x)
    if kind == "vecbin":
        raw = np.fromfile(path, np.int32, 2)
        assert tuple(raw) == (300, 7) == vectors.metadata(path)
    else:
        assert np.fromfile(path, np.int32, 1)[0] == 7


def test_refusals(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"\x05\0\0\0\x02\0\0\0abc")
    with pytest.raises(Exception, match="shorter"):
        vectors.read(spark, str(tmp_path / "bad")).count()
    with pytest.raises(Exception, match="dtype"):
        vectors.read(spark, str(tmp_path / "bad"), "double").count()


def test_tsv_and_labels(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a,b\r\nall\n b , c\textra\n\n")
    points = texts.read_labels(spark, str(tmp_path / "l.txt"))
    assert {r.id: r.labels for r in points.collect()} == {0: ["a", "b"], 1: ["all"], 2: ["b", "c"], 3: []}
    coded, table = labels.encode(points, "all")
    assert {r.label: r.label_id for r in table.collect()} == {"all": 0, "a": 1, "b": 2, "c": 3}
    assert {r.id: r.labels for r in coded.collect()} == {0: [1, 2], 1: [0], 2: [2, 3]}
    asked = spark.createDataFrame([(1, "a"), (2, "z")], "query_id bigint, label string")
    assert {r.query_id: r.label_id for r in labels.convert(asked, table, 0).collect()} == {1: 1, 2: 0}
    with pytest.raises(Exception, match="unknown label"):
        labels.convert(asked, table).collect()
    rows = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(50)], "id bigint, vec array<float>")
    texts.write_tsv(rows, str(tmp_path / "t"))
    assert [tuple(r) for r in texts.read_tsv(spark, str(tmp_path / "t")).orderBy("id").collect()] == [tuple(r) for r in rows.collect()]


def test_json(spark):
    lines = ['{"query_id": 1, "query": [1, 2], "k": 2}', '{"query_id": 2, "query": [], "k": 2}', '{"query_id": 3, "query": [1], "k": 0}', '{"query_id": 4, "query": [1], "k": 9, "Ls": 5}', "{"]
    good, bad = texts.parse_queries(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.query_id, r.vec, r.k, r.width) for r in good.collect()] == [(1, [1.0, 2.0], 2, 100)]
    assert bad.count() == 4
    results = spark.createDataFrame([(1, 2, 8, 0.5), (1, 1, 7, 0.25)], "query_id bigint, rank bigint, id bigint, distance double")
    out = [json.loads(r.value) for r in texts.answers_json(results, bad).collect()]
    assert {"query_id": 1, "k": 2, "indices": [7, 8], "distances": [0.25, 0.5]} in out and sum("error" in x for x in out) == 4
    wide = texts.truth_wide(results)
    assert sorted(map(tuple, texts.truth_long(wide).collect())) == sorted(map(tuple, results.collect()))


def test_tables(spark, tmp_path):
    t = spark.range(5).withColumn("x", F.array("id"))
    texts.save_tables(str(tmp_path / "i"), {"points": t}, {"metric": "l2"})
    back, meta = texts.load_tables(spark, str(tmp_path / "i"), ["points"])
    assert meta == {"metric": "l2"} and back["points"].count() == 5
    texts.write_csv(t, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5


def test_synthetic_labels(spark, monkeypatch):
    for n, block in ((2000, 65_536), (2003, 300), (1, 5), (0, 5)):
        monkeypatch.setattr(labels, "BLOCK", block)
        zipf = labels.synthetic(spark, n, 20, "zipf").collect()
        assert sorted(r.id for r in zipf) == list(range(n))
        got = collections.Counter(v for r in zipf for v in r.labels)
        assert {v: got[v] for v in range(1, 21)} == {v: math.ceil(0.7 * n) // v for v in range(1, 21)}
        assert all(r.labels == sorted(set(r.labels)) and r.labels and (0 not in r.labels or r.labels == [0]) for r in zipf)
    assert labels.synthetic(spark, 500, 6, "random").where(F.size("labels") > 6).count() == 0
    assert labels.synthetic(spark, 100, 4, "one_per_point").where(F.size("labels") != 1).count() == 0
    with pytest.raises(ValueError):
        labels.synthetic(spark, 1, 1, "x")


def test_query_mixes_have_their_counts(spark):
    base = spark.range(400).select("id", F.array(F.col("id").cast("float")).alias("vec"))
    x, y = base.where("id < 100").select("id"), base.where("id >= 380").select("id")
    for mix, want in (("uniform", (0, 0, 50)), ("x_only", (50, 0, 0)), ("mostly_x", (40, 0, 10)), ("mostly_y", (0, 40, 10)), ("both", (25, 25, 0)), ("x_then_y", (25, 25, 0))):
        rows = workloads.query_mix(base, x, y, 50, mix).collect()
        assert sorted(r.query_id for r in rows) == list(range(50))
        n = collections.Counter(r.source for r in rows)
        assert (n["x"], n["y"], n["all"]) == want
        inside = {"x": range(100), "y": range(380, 400), "all": range(400)}
        assert all(int(r.vec[0]) in inside[r.source] for r in rows)
        if n["x"]:  # large enough: no point twice
            assert len({r.vec[0] for r in rows if r.source == "x"}) == n["x"]
        assert sorted(workloads.query_mix(base.repartition(3), x, y, 50, mix).collect()) == sorted(rows)
    order = sorted(workloads.query_mix(base, x, y, 51, "x_then_y").collect())
    assert [r.source for r in order] == ["x"] * 26 + ["y"] * 25
    with pytest.raises(ValueError):
        workloads.query_mix(base, x.limit(0), y, 5, "x_only")


@pytest.mark.parametrize("far", [True, False])
def test_truth_files_come_back(spark, tmp_path, far):
    rng = np.random.default_rng(3)
    rows = [(q, r, int(rng.integers(0, 2**32)), float(np.float32(rng.random()))) for q in range(700) for r in range(1, 6)]
    t = spark.createDataFrame(rows, "query_id bigint, rank bigint, id bigint, distance double").repartition(5)
    t = t if far else t.drop("distance")
    path = str(tmp_path / "t")
    truth.write_truth(t, path)
    back = truth.read_truth(spark, path)
    assert (tmp_path / "t").stat().st_size == 8 + 4 * 3500 * (2 if far else 1)
    assert sorted(map(tuple, back.select("query_id", "rank", "id", *(["distance"] if far else [])).collect())) == sorted(r if far else r[:3] for r in rows)
    for bad in (t.where("query_id <> 3"), t.where("not (query_id = 9 and rank = 2)"), t.withColumn("id", F.col("id") - (1 << 33))):
        with pytest.raises(ValueError):
            truth.write_truth(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_range_truth_and_id_maps_come_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(q, int(i)) for q in range(300) for i in rng.choice(5000, rng.integers(0, 9), replace=False) if q % 7]
    pairs = spark.createDataFrame(rows, "query_id bigint, id bigint").repartition(5)
    path = str(tmp_path / "r")
    truth.write_range_truth(pairs, 300, path)
    assert sorted(map(tuple, truth.read_range_truth(spark, path).collect())) == sorted(rows)
    truth.write_range_truth(pairs.limit(0), 4, path)
    assert truth.read_range_truth(spark, path).count() == 0 and (tmp_path / "r").stat().st_size == 8 + 16
    with pytest.raises(ValueError):
        truth.write_range_truth(pairs, 100, path)
    ids = spark.range(1000).select(F.col("id").alias("place"), (F.col("id") * 4_000_000 + 7).alias("id")).repartition(3)
    truth.write_id_map(ids, str(tmp_path / "m"))
    assert sorted(map(tuple, truth.read_id_map(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, ids.collect()))
    with pytest.raises(ValueError):
        truth.write_id_map(ids.where("place > 0"), str(tmp_path / "x"))
