"""Searches in step over small shards against one search at a time, and what a partition of shards leaves."""

import numpy as np
import pyarrow as pa
import pytest

from gridvane.operators import kernels, vamana
from gridvane.operators.knn import distances


@pytest.mark.parametrize("seed", range(8))
def test_walks_in_step(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 300)), int(rng.integers(1, 60))
    x, q = rng.normal(size=(n, 8)).astype(np.float32), rng.normal(size=(30, 8)).astype(np.float32)
    if seed % 2:
        x[n // 2 :] = x[0]  # copies: ties go to the smaller number
    nbrs, start = kernels.build(x, 10, 20)
    starts = rng.integers(0, n, 3) if seed % 3 else np.array([start])
    d = kernels.pairwise("l2", q, x)
    order, held, hops, compared = kernels.walked(d, nbrs, starts, width)
    for i in range(len(q)):
        ids, _, _, h, c = kernels.greedy_search(q[i], x, nbrs, starts, width, measure=lambda j, i=i: d[i, j])
        assert order[i][held[i]].tolist() == ids.tolist() and (hops[i], compared[i]) == (h, c)


@pytest.mark.parametrize("small", [2048, 0])
def test_a_partition_leaves_k_rows_a_query(monkeypatch, small):
    """Of five shards that share points: the k nearest of all lists once each, one row of statistics, none of the deleted points."""
    monkeypatch.setattr(vamana, "SMALL", small)
    rng = np.random.default_rng(5)
    x, q, k, width = rng.normal(size=(200, 8)).astype(np.float32), rng.normal(size=(20, 8)), 7, 20
    x[50:60] = x[40]
    dead = np.arange(200) % 9 == 0
    tables, want, hops, compared = [], [set() for _ in q], np.zeros((5, len(q)), np.int64), np.zeros((5, len(q)), np.int64)
    for s in range(5):
        ids = np.sort(rng.choice(200, 80, replace=False))
        nbrs, start = kernels.build(x[ids], 10, 20)
        rows = vamana._rows(s, ids, pa.array(list(x[ids]), pa.list_(pa.float32())), [r[r >= 0] for r in nbrs], pa.nulls(80, pa.list_(pa.int64())), start)
        tables.append(rows.append_column("dead", pa.array(dead[ids])))
        for i in range(len(q)):
            got, _, _, hops[s, i], compared[s, i] = kernels.greedy_search(q[i].astype(np.float32), x[ids], nbrs, np.array([start]), width)
            want[i] |= set(ids[got].tolist())
    batches = pa.concat_tables(tables).combine_chunks().to_batches(max_chunksize=33)  # shards end within batches
    block = [{"query_id": 100 * i, "vec": v.tolist()} for i, v in enumerate(q)]
    rows = pa.Table.from_batches(list(vamana._plain_searcher(block, k, width)(iter(batches)))).to_pylist()
    assert len(rows) == len(q) * (k + 1)
    d = distances("l2", q, x.astype(np.float64))
    for i in range(len(q)):
        near = sorted((d[i, j], j) for j in want[i] if not dead[j])[:k]
        assert [(r["distance"], r["id"]) for r in rows if r["query_id"] == 100 * i and r["id"] is not None] == near
        (stats,) = [r for r in rows if r["query_id"] == 100 * i and r["id"] is None]
        assert (stats["hops"], stats["n_compared"], stats["n_ios"]) == (hops[:, i].max(), compared[:, i].sum(), hops[:, i].sum())
    assert list(vamana._plain_searcher(block, k, width)(iter([]))) == []
