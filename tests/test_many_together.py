"""What graph kernels do for many points together, against the same one by one."""

import numpy as np
import pytest

from gridvane.operators import kernels


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).integers(-9, 9, (400, 8)).astype(np.float32)  # whole numbers: products are exact


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("with_labels", [False, True])
@pytest.mark.parametrize("saturate", [False, True])
def test_prune(x, metric, with_labels, saturate, monkeypatch):
    monkeypatch.setattr(kernels, "PRUNED_AT_ONCE", 40_000)  # several rounds
    rng = np.random.default_rng(4)
    points = rng.permutation(400)[:60]
    pools = [np.setdiff1d(rng.permutation(400)[: rng.integers(0, 90)], [p]) for p in points]
    labels = [frozenset(rng.integers(0, 70, 2).tolist()) for _ in range(400)] if with_labels else None
    got = kernels.prune(points, pools, x, 12, 1.2, 80, metric, kernels.Sharing(labels) if labels else None, saturate)
    for p, pool, mine in zip(points, pools, got):
        d = kernels.pairwise(metric, x[p : p + 1], x[pool])[0]
        assert mine.tolist() == kernels.robust_prune(pool, d, x, 12, 1.2, 80, metric, labels, labels[p] if labels else None, saturate).tolist()


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "fast_l2"])
def test_stepped(metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x = x / np.sqrt((x * x).sum(1, keepdims=True)) if metric == "cosine" else x
    graph, start = kernels.build(x, 10, 20)
    q, allowed = x[::20] + np.float32(0.01), rng.random((30, 600)) < 0.7
    first = [np.unique([start, *rng.integers(0, 600, i % 4)]) for i in range(30)]
    for mask in (None, allowed[0], allowed):
        ids, dist, (row, node), hops, compared = kernels.stepped(q, x, graph, kernels.padded(first, 4), 15, metric, mask)
        for i in range(30):
            own = mask if mask is None or mask.ndim == 1 else mask[i]
            want, d, expanded, h, c = kernels.greedy_search(q[i], x, graph, first[i], 15, metric, own)
            assert ids[i][ids[i] >= 0].tolist() == want.tolist()
            assert np.allclose(dist[i][ids[i] >= 0], d, atol=1e-4)
            assert node[row == i].tolist() == expanded.tolist()
            assert (hops[i], compared[i]) == (h, c)


def test_insert_links_batches(x, monkeypatch):
    """Points of a batch find each other, and searches go in step: none of insert's is by itself."""
    monkeypatch.setattr(kernels, "greedy_search", None)
    x = np.random.default_rng(6).normal(size=(500, 8)).astype(np.float32)
    x[300:] += 20  # what comes new lies together, far from what is there
    graph, start = kernels.build(x[:250], 10, 20)
    lists = [r[r >= 0] for r in graph]
    kernels.insert(x, lists, 250, np.array([start]), 10, 20, 1.2, "l2")
    nbrs = kernels.padded(lists, max(map(len, lists)))
    got = kernels.stepped(x[300:], x, nbrs, np.full((200, 1), start), 30)[0]
    assert (got[:, 0] == np.arange(300, 500)).mean() > 0.95
