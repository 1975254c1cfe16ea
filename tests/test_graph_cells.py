"""The exact graph's cells are dealt one to a task."""

import numpy as np
import pytest
from pyspark import TaskContext

from gridvane.operators import knn


@pytest.mark.parametrize("rows", [50, 1000])
def test_a_task_for_each_cell(spark, monkeypatch, rows):
    """By a hash of their number, some of the 36 cells would share a task."""
    monkeypatch.setattr(knn, "GROUP_ROWS", rows)
    monkeypatch.setattr(knn, "SMALL_GROUP", 50)
    monkeypatch.setattr(knn, "_meet", lambda a_ids, a, b_ids, b, k, same: [(np.array([TaskContext.get().partitionId()]), a_ids[:1] * 1000 + b_ids[:1], np.zeros(1))])
    x = np.random.default_rng(7).standard_normal((400, 3))
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>")
    tasks = [r.query_id for r in knn.nearest_others(base, 8).collect()]
    assert sorted(tasks) == list(range(36))


def test_rows_enter_by_distance_then_id():
    """What comes at once for a row, in any order, leaves the k least; NaN comes last, and fewer than k leave places free."""
    seen = knn._Nearest(4, 3)
    seen.add(np.array([2, 0, 2, 2, 3, 2]), np.array([4.0, 1.0, np.nan, 4.0, np.nan, 5.0]), np.array([9, 5, 1, 3, 8, 2]))
    seen.add(np.array([3, 2, 0]), np.array([7.0, 4.0, 1.0]), np.array([1, 4, 4]))
    who, ids, d = seen.rows(np.arange(4) * 10)
    assert who.tolist() == [0, 0, 20, 20, 20, 30, 30] and ids.tolist() == [4, 5, 3, 4, 9, 1, 8]
    assert np.array_equal(d, [1, 1, 4, 4, 4, 7, np.nan], equal_nan=True)
