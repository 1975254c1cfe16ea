"""Dynamic index, sliding window and memory pool."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridvane.operators import maintenance
from gridvane.streaming import pool
from gridvane.streaming.dynamic import DynamicIndex, sliding_window

KIND = "id bigint, vec array<float>"


def points(spark, n, first=1):
    rng = np.random.default_rng(first)
    return spark.createDataFrame([(first + i, rng.random(6).tolist()) for i in range(n)], KIND)


def test_insert_delete_search(spark, tmp_path):
    index = DynamicIndex(spark, str(tmp_path / "i"), degree=8, width=16, capacity=120)
    assert index.version() == -1
    index.insert(points(spark, 100))
    new = spark.createDataFrame([(1001, [2.0] * 6), (1002, [3.0] * 6), (0, [1.0] * 6), (5, [1.0] * 6)], KIND)
    assert {(r.id, r.reason) for r in index.insert(new).collect()} == {(0, "reserved"), (5, "duplicate")}
    ask = spark.createDataFrame([(1, [2.0] * 6)], "query_id bigint, vec array<float>")
    assert index.search(ask, 3, 16).where("rank = 1").first().id == 1001
    failed = index.delete(spark.createDataFrame([(1001,), (7777,)], "id bigint"))
    assert [r.id for r in failed.collect()] == [7777]
    assert 1001 not in {r.id for r in index.search(ask, 10, 16).collect()} and index.vector(1001) is None and index.vector(1002) == [3.0] * 6
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert index.search(ask, 20, 5).count() in (19, 20)  # a deleted one may take a place
        index.insert(points(spark, 19, 2000))
    assert {"raised", "consolidating"} <= {w for s in seen for w in str(s.message).split()}
    assert index.n_live() == 120
    with pytest.raises(RuntimeError):
        index.insert(points(spark, 5, 3000))
    again = DynamicIndex(spark, str(tmp_path / "i"))
    assert again.n_live() == 120 and 1001 not in {r.id for r in again.search(ask, 10, 16).collect()}
    report = index.consolidate().first()
    assert report.status == "SUCCESS" and report.n_live == 120 and report.n_freed == 0


def test_stream_of_changes(spark, tmp_path):
    src = tmp_path / "in"
    kind = "op string, id bigint, vec array<float>"
    rows = points(spark, 40).select(F.lit("insert").alias("op"), "id", "vec").unionByName(spark.createDataFrame([("delete", 3, None), ("consolidate", None, None)], kind))
    rows.coalesce(1).write.json(str(src))
    index = DynamicIndex(spark, str(tmp_path / "i"), degree=8, width=16)
    query = index.stream(spark.readStream.schema(kind).json(str(src)), str(tmp_path / "c"))
    query.awaitTermination()
    assert index.version() == 3 and index.n_live() == 39 and index.table("tombstones").isEmpty()


def test_replayed_batches(spark, tmp_path):
    """A batch that comes again changes nothing, wherever it was cut short."""
    kind = "op string, id bigint, vec array<float>"
    add = lambda n, first: points(spark, n, first).select(F.lit("insert").alias("op"), "id", "vec")
    first = add(40, 1)
    second = add(40, 100).unionByName(spark.createDataFrame([("delete", 3, None), ("delete", 100, None)], kind))
    third = spark.createDataFrame([("consolidate", None, None)], kind)
    index = DynamicIndex(spark, str(tmp_path / "i"), degree=8, width=16)
    state = lambda: (index.version(), index.n_live(), sorted(r.id for r in index.table("tombstones").collect()))
    index.apply(first, 0)
    # cut short after the insertion: the deletions are made when the batch comes again
    index.insert(second.where("op = 'insert'").select("id", "vec"), 5)
    assert state() == (5, 80, [])
    index.apply(second, 1)
    assert state() == (6, 78, [3, 100])
    for batch, number in ((second, 1), (first, 0)):
        index.apply(batch, number)
        assert state() == (6, 78, [3, 100])
    # tables written but not named, as by a writer that died
    index.table("index").limit(3).write.parquet(str(tmp_path / "i" / "v11-dead" / "index"))
    index.apply(third, 2)
    index.apply(third, 2)
    index.apply(second, 1)
    assert state() == (11, 78, []) and index.table("index").select("id").distinct().count() == 78
    # a deletion leaves the index where it was
    index.delete(spark.createDataFrame([(5,)], "id bigint"))
    assert index._folders(12)["index"] == index._folders(11)["index"] and index.n_live() == 77


def test_log_in_its_order(spark, tmp_path):
    """With a column seq, the last change of an id counts."""
    index = DynamicIndex(spark, str(tmp_path / "i"), degree=8, width=16)
    kind = "seq bigint, op string, id bigint, vec array<float>"
    vec = [0.5] * 6
    index.apply(points(spark, 30).select(F.lit("insert").alias("op"), "id", "vec"), 0)
    rows = [(1, "insert", 50, vec), (2, "delete", 50, None), (3, "insert", 50, vec), (4, "insert", 51, vec), (5, "delete", 51, None), (6, "delete", 7, None), (7, "consolidate", None, None)]
    index.apply(spark.createDataFrame(rows, kind).repartition(3), 1)
    live = {r.id for r in index.points().select("id").collect()}
    assert live == set(range(1, 31)) - {7} | {50} and index.table("tombstones").isEmpty()


def test_changes_are_what_is_written(spark, tmp_path):
    """A batch writes in proportion to itself; what is read is the same before and after compaction."""
    home = tmp_path / "i"
    index = DynamicIndex(spark, str(home), degree=8, width=16)
    size = lambda: sum(f.stat().st_size for f in home.rglob("*.parquet"))
    rows = lambda: sorted((r.shard, r.id, tuple(r.vec), tuple(sorted(r.nbrs)), r.start) for r in index.table("index").collect())
    index.insert(points(spark, 2000))
    base = size()
    index.insert(points(spark, 5, 5000))
    one = size() - base
    assert one < base / 4
    index.delete(points(spark, 3, 40).select("id"))
    index.consolidate()
    index.insert(points(spark, 2, 41))  # ids that went come back with other vectors
    folders = index._folders(index.version())
    assert len(folders["changes"]) == 3 and folders["index"].startswith("v0-")
    before = rows()
    assert len(before) == 2004 and index.n_live() == 2004 and index.vector(40) is None
    assert np.allclose(index.vector(41), np.random.default_rng(41).random((2, 6))[0])
    index.compact()
    assert rows() == before and index._folders(index.version())["changes"] == []
    for i in range(10):
        index.insert(points(spark, 1, 6000 + i))
    assert len(index._folders(index.version())["changes"]) <= 8 and index.n_live() == 2014
    ask = spark.createDataFrame([(1, index.vector(6009))], "query_id bigint, vec array<float>")
    assert index.search(ask, 1, 16).first().id == 6009


def test_start_points_of_a_dynamic_index(spark, tmp_path):
    index = DynamicIndex(spark, str(tmp_path / "i"), degree=8, width=16, capacity=60, frozen=2)
    index.insert(points(spark, 40))
    assert index.n_live() == 40 and index.table("index").count() == 42
    index.delete(points(spark, 40).select("id"))
    assert index.consolidate().first().n_freed == 40 and index.n_live() == 0
    index.insert(points(spark, 60, 100))  # linked to the start points that stayed
    ask = spark.createDataFrame([(1, [0.5] * 6)], "query_id bigint, vec array<float>")
    found = index.search(ask, 10, 30)
    assert found.count() == 10 and found.where("id < 100").count() == 0


def test_sliding_window(spark, tmp_path):
    data = points(spark, 60, 1).select((F.col("id") - 1).alias("position"), "vec")
    index = DynamicIndex(spark, str(tmp_path / "w"), degree=8, width=16)
    done = sliding_window(index, data, 30, 10)
    want = {r.step: r.n for r in maintenance.window_live(data, 30, 10, 60).groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {d["step"]: d["live"] for d in done} == want


def brute_pool(items, capacity):
    slots, out = [], []
    for item in items:
        k = next((i for i, s in enumerate(slots) if s[0] == item), None)
        if k is not None:
            slots[k][1] += 1
            out.append((True, None))
        elif len(slots) < capacity:
            slots.append([item, 1])
            out.append((False, None))
        else:
            k = min(range(capacity), key=lambda i: slots[i][1])
            out.append((False, slots[k][0]))
            slots[k] = [item, 1]
    return out


def test_pool(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(p, i, int(x)) for p in range(3) for i, x in enumerate(rng.zipf(1.5, 200) % 30)]
    requests = spark.createDataFrame(rows, "pool bigint, seq bigint, item bigint")
    got = {(r.pool, r.seq): (r.hit, r.evicted) for r in pool.replay(requests.repartition(4), 8).collect()}
    for p in range(3):
        assert [got[p, i] for i in range(200)] == brute_pool([x for q, _, x in rows if q == p], 8)
    answers = pool.replay(requests, 8)
    assert pool.hit_rate(answers).agg(F.sum("n_requests")).first()[0] == 600
    assert pool.first_requests(requests).join(answers.where("hit"), ["pool", "seq"]).count() == 0
    # the same as a stream of two files
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    requests.where("seq < 100").coalesce(1).write.mode("append").parquet(src)
    requests.where("seq >= 100").coalesce(1).write.mode("append").parquet(src)
    files = sorted(x for x in (tmp_path / "s").iterdir() if x.suffix == ".parquet")
    import os

    os.utime(files[0]), os.utime(files[1])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = pool.stream(spark.readStream.schema(requests.schema).parquet(src), 8)
        query = live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    streamed = {(r.pool, r.seq): (r.hit, r.evicted) for r in spark.read.parquet(out).collect()}
    assert streamed == got
    with pytest.raises(ValueError):
        pool.Pool(0)
