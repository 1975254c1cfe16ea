"""The neighbours of every row: like the search with every row as a query, in bounded tasks, once a query."""

import numpy as np
import pytest

from gridvane import catalogue
from gridvane.operators import knn
from gridvane.plans import greedy

from .conftest import SF


def _table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids if ids is not None else range(len(x)), x)], "id bigint, vec array<double>")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())


def _plain(base, k):
    near = knn.exact(base, base.select(base["id"].alias("query_id"), "vec"), k + 1).where("query_id <> id")
    return knn.ranked(near.select("query_id", "id", "distance"), k).select("query_id", "rank", "id", "distance")


@pytest.mark.parametrize("kind", ["spread", "copies", "far", "tiny", "grid"])
def test_like_the_search(spark, monkeypatch, kind):
    monkeypatch.setattr(knn, "SMALL_GROUP", 100)
    monkeypatch.setattr(knn, "PIECE", (32, 64))
    rng = np.random.default_rng(4)
    x = rng.standard_normal((350, 12))
    if kind == "copies":
        x[40:200] = x[40]
    if kind == "far":
        x[:, 0] += 1e5
        x[3] *= 1e7
    if kind == "tiny":
        x *= 1e-23
    if kind == "grid":
        x = np.rint(x)
    base = _table(spark, x, rng.permutation(1000)[:350])
    assert _rows(knn.nearest_others(base, 8)) == _rows(_plain(base, 8))


def test_not_finite():
    """NaN comes after all numbers, an infinite distance not at all; in single precision 1e25 squared is infinite."""
    x = np.random.default_rng(5).standard_normal((40, 4)) * 1e25
    x[3], x[4, 0] = np.nan, np.inf
    ids = np.arange(40)
    with np.errstate(invalid="ignore"):
        (who, near, d), = knn._meet(ids, x, ids, x, 5, True)
        want = knn.distances("l2", x, x)
    for q in range(40):
        order = sorted((i for i in range(40) if i != q and want[q, i] != np.inf), key=lambda i: (np.isnan(want[q, i]), np.nan_to_num(want[q, i]), i))[:5]
        assert near[who == q].tolist() == order and np.array_equal(d[who == q], want[q, order], equal_nan=True)


def test_few_rows(spark):
    x = np.eye(3)
    assert _rows(knn.nearest_others(_table(spark, x), 8)) == [(q, r + 1, i, 2.0) for q in range(3) for r, i in enumerate(j for j in range(3) if j != q)]
    assert _rows(knn.nearest_others(_table(spark, x[:1]), 8)) == [] == _rows(knn.nearest_others(_table(spark, x).where("id < 0"), 8))
    with pytest.raises(ValueError):
        knn.nearest_others(_table(spark, x), 0)


def test_tasks_are_bounded(spark, monkeypatch):
    """No pair of groups holds more than two groups' rows, and each gives k rows for each of its own."""
    monkeypatch.setattr(knn, "GROUP_ROWS", 50)
    seen = spark.sparkContext.accumulator(0)

    def counted(a_ids, a, b_ids, b, k, same, meet=knn._meet):
        seen.add(1)
        assert len(a) < 100 and len(b) < 100
        for found in meet(a_ids, a, b_ids, b, k, same):
            assert len(found[0]) <= 100 * k
            yield found

    monkeypatch.setattr(knn, "_meet", counted)
    base = _table(spark, np.random.default_rng(6).standard_normal((400, 5)))
    assert knn.nearest_others(base, 8).count() == 3200
    assert seen.value >= 36


@pytest.mark.parametrize("name", ["layout_directed_beam", "layout_edge_star", "page_capture"])
def test_graph_is_made_once(spark, monkeypatch, name):
    calls, real = [], catalogue.edges
    monkeypatch.setattr(catalogue, "edges", lambda *a: calls.append(a) or real(*a))
    catalogue.QUERIES[name](spark, SF)
    assert len(calls) == 1


def test_packer_touches_what_it_needs():
    """A layout of few slots makes Python objects of the edges around its pages, not of all."""
    n = 3000
    u = np.repeat(np.arange(n), 8)
    v = (u + np.tile(np.arange(1, 9), n)) % n
    for layout in greedy.LAYOUTS:
        p = greedy.Packer({i: 1 for i in range(n)}, (u, v, 1 + (u * 31 + v * 17) % 23), (u, v), 5, 60)
        assert sum(map(len, greedy.pack(p, layout))) >= 60
        assert len(p.both) + len(p.arcs) + len(p.adjacent) < 1500, layout
