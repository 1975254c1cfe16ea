"""Disk layout, cache lists and binary truth files against plain versions."""

import random
import struct

import numpy as np
import pytest

from gridvane.operators import disk
from gridvane.sources import truth, vectors


def edges_of(spark, n, seed):
    rng = random.Random(seed)
    nbrs = {i: sorted(rng.sample([j for j in range(n) if j != i], rng.randint(0, 4))) for i in range(n)}
    return nbrs, spark.createDataFrame([(i, j) for i in nbrs for j in nbrs[i]], "src bigint, dst bigint")


@pytest.mark.parametrize("budget, total", [(7, 200), (200, 200), (1, 3), (30, 1000)])
def test_cache_by_levels(spark, budget, total):
    nbrs, edges = edges_of(spark, 60, budget)
    starts = [(5, 0), (9, 1), (5, 2)]
    got = disk.cache_by_levels(edges, spark.createDataFrame(starts, "id bigint, place bigint"), budget, total).collect()
    most = budget if budget <= int(total * 0.1 + 0.5) else max(1, int(total * 0.1 + 0.5))
    want = {5: 0} if most == 1 else {5: 0, 9: 0}
    layer, level = list(want), 0
    while len(want) < most and layer:
        level, fresh = level + 1, []
        for i in sorted(layer):
            fresh += [j for j in nbrs[i] if j not in want and j not in fresh]
        layer = fresh[: most - len(want)]
        want |= dict.fromkeys(layer, level)
    assert {r.id: r.level for r in got} == want and len(got) == len(want)


def test_cache_by_visits(spark):
    visits = spark.createDataFrame([(0, 3), (1, 3), (1, 2), (2, 2), (2, 7)], "query_id bigint, id bigint")
    nodes = spark.range(9)
    assert [tuple(r) for r in disk.cache_by_visits(visits, nodes, 4).collect()] == [(2, 2), (3, 2), (7, 1), (0, 0)]
    assert disk.cache_by_visits(visits, nodes, 50).count() == 9
    assert disk.cache_by_visits(visits.limit(0), nodes, 2).count() == 2


@pytest.mark.parametrize("dim, reorder", [(64, 0), (64, 128), (3000, 16)])
def test_layout(spark, tmp_path, dim, reorder):
    graph = spark.createDataFrame([(i, list(range(i % 5))) for i in range(40)], "id bigint, nbrs array<bigint>")
    placed = disk.layout(graph, 40, dim, 4, reorder)
    disk.write_layout(placed, f"{tmp_path}/layout")
    got = spark.read.parquet(f"{tmp_path}/layout").collect()
    size = 4 * dim + 4 * 5
    per, wide = 4096 // size, -(-size // 4096)
    for r in got:
        assert (r.sector, r.slot) == ((1 + r.id // per, r.id % per) if per else (1 + r.id * wide, 0))
        if reorder:
            first = 1 + (-(-40 // per) if per else 40 * wide)
            assert (r.reorder_sector, r.reorder_slot) == (first + r.id // (1024 // reorder), r.id % (1024 // reorder))
    assert len(got) == 40
    with pytest.raises(ValueError):
        disk.layout(graph, 40, dim, 4, 1025)


def test_permute_codes(spark):
    codes = spark.createDataFrame([(i, [i, i + 1]) for i in range(5)], "id bigint, code array<smallint>")
    order = spark.createDataFrame([(4 - i, i) for i in range(5)], "new_id bigint, old_id bigint")
    assert {r.id: r.code for r in disk.permute_codes(codes, order).collect()} == {4 - i: [i, i + 1] for i in range(5)}
    for bad in (order.where("old_id < 4"), order.unionByName(order.limit(1))):
        with pytest.raises(ValueError):
            disk.permute_codes(codes, bad)


@pytest.mark.parametrize("n, far", [(3, True), (3, False), (0, True)])
def test_truth(spark, tmp_path, monkeypatch, n, far):
    monkeypatch.setattr(truth, "ROWS", 2)
    ids, d = np.arange(n * 4, dtype="<u4") + 2**31, np.linspace(0, 1, n * 4).astype("<f4")
    path = tmp_path / "truth"
    path.write_bytes(struct.pack("<ii", n, 4) + ids.tobytes() + (d.tobytes() if far else b""))
    got = sorted(tuple(r) for r in truth.read_truth(spark, str(path)).collect())
    assert got == [(i // 4, i % 4 + 1, int(ids[i]), float(d[i]) if far else None) for i in range(n * 4)]
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(ValueError):
        truth.read_truth(spark, str(path))


def test_range_truth(spark, tmp_path):
    counts, path = [2, 0, 3], tmp_path / "range"
    path.write_bytes(struct.pack("<ii3i5I", 3, 5, *counts, 9, 8, 7, 6, 2**32 - 1))
    got = sorted(tuple(r) for r in truth.read_range_truth(spark, str(path)).collect())
    assert got == [(0, 8), (0, 9), (2, 6), (2, 7), (2, 2**32 - 1)]
    path.write_bytes(struct.pack("<ii3i5I", 3, 5, 2, 0, 2, 9, 8, 7, 6, 5))
    with pytest.raises(ValueError):
        truth.read_range_truth(spark, str(path))


def test_id_map(spark, tmp_path):
    vectors.register(spark)
    path = tmp_path / "ids"
    path.write_bytes(struct.pack("<ii3I", 3, 1, 5, 2**32 - 2, 0))
    assert sorted(tuple(r) for r in truth.read_id_map(spark, str(path)).collect()) == [(0, 5), (1, 2**32 - 2), (2, 0)]
    path.write_bytes(struct.pack("<ii4I", 2, 2, 5, 6, 7, 8))
    with pytest.raises(ValueError):
        truth.read_id_map(spark, str(path))
