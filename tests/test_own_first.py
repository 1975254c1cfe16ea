"""In a larger table each group meets itself first, and what it finds bounds what the other groups have to look at."""

import numpy as np
import pytest

from gridvane.operators import knn


def _table(spark, x, ids):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "id bigint, vec array<double>")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())


@pytest.mark.parametrize("kind", ["spread", "copies", "far", "tiny", "grid", "few"])
def test_like_all_at_once(spark, monkeypatch, kind):
    """The rows of both ways are those of the search; groups of less than k + 1 rows bound nothing."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((40 if kind == "few" else 350, 12))
    if kind == "copies":
        x[40:200] = x[40]
    if kind == "far":
        x[:, 0] += 1e5
        x[3] *= 1e7
    if kind == "tiny":
        x *= 1e-23
    if kind == "grid":
        x = np.rint(x)
    monkeypatch.setattr(knn, "SMALL_GROUP", 6 if kind == "few" else 60)
    base = _table(spark, x, rng.permutation(1000)[: len(x)])
    near = knn.exact(base, base.select(base["id"].alias("query_id"), "vec"), 9).where("query_id <> id")
    want = _rows(knn.ranked(near.select("query_id", "id", "distance"), 8).select("query_id", "rank", "id", "distance"))
    monkeypatch.setattr(knn, "OWN_FIRST", 0)
    assert _rows(knn.nearest_others(base, 8)) == want


def test_other_groups_leave_less(spark, monkeypatch):
    """All at once, each of 8 groups leaves k for each row."""
    monkeypatch.setattr(knn, "SMALL_GROUP", 100)
    monkeypatch.setattr(knn, "OWN_FIRST", 0)
    left = spark.sparkContext.accumulator(0)

    def counted(*args, meet=knn._meet):
        for found in meet(*args):
            left.add(len(found[0]))
            yield found

    monkeypatch.setattr(knn, "_meet", counted)
    x = np.random.default_rng(15).standard_normal((800, 4))
    assert knn.nearest_others(_table(spark, x, range(800)), 8).count() == 6400
    assert left.value < 800 * 8 * 8


def test_copies_take_nothing_more():
    """A row that has k copies with smaller ids takes no copy from another group; one without a bound does."""
    x, nobody = np.ones((50, 3)), np.iinfo(np.int64).max
    known = ((np.zeros(50), np.full(50, 7)), (np.full(50, np.nan), np.full(50, nobody)))
    near, back = knn._meet(np.arange(10, 60), x, np.arange(100, 150), x, 8, False, known)
    assert len(near[0]) == 0 and len(back[0]) == 400


def test_a_bound_keeps_what_ties_with_it():
    """What is as far as the bound stays, as ids decide later; what is farther goes; a row without a bound takes k."""
    a, b = np.zeros((3, 1)), np.array([[1.0], [1.0], [2.0], [3.0]])
    nobody = np.iinfo(np.int64).max
    known = ((np.array([1.0, 0.0, np.nan]), np.array([50, 5, nobody])), (np.full(4, np.nan), np.full(4, nobody)))
    (who, ids, d), _ = knn._meet(np.array([1, 2, 3]), a, np.array([10, 11, 12, 13]), b, 3, False, known)
    assert who.tolist() == [1, 1, 3, 3, 3] and ids.tolist() == [10, 11, 10, 11, 12] and d.tolist() == [1, 1, 1, 1, 4]
