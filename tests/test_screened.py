"""Exact search by screened products, against all distances."""

import numpy as np
import pyarrow as pa
import pytest

from gridvane.operators import knn


@pytest.mark.parametrize("metric", ["l2", "ip", "fast_l2"])
@pytest.mark.parametrize("odd", ["", "nan", "huge", "same"])
@pytest.mark.parametrize("wanted", [False, True])
def test_screener(metric, odd, wanted):
    rng = np.random.default_rng(1)
    base, k = rng.normal(size=(1200, 6)) * 3, 7
    base[100:140] = base[5]  # ties
    if odd == "nan":
        base[50, 2] = np.nan
    if odd == "huge":
        base[60] = 1e200
    if odd == "same":
        base[:] = base[0]
    ids, q = np.arange(70) + 10, base[rng.permutation(1200)[:70]]
    labels = [[int(i % 5), 9] if i % 50 == 0 else [int(i % 5)] for i in range(1200)]
    want = [int(i % 6) for i in range(70)] if wanted else None
    batch = pa.record_batch([pa.array(np.arange(1200)), pa.array(list(base), pa.list_(pa.float64())), pa.array(labels, pa.list_(pa.int64()))], ["id", "vec", "labels"])
    with np.errstate(all="ignore"):
        rows = [b for b in knn._screener(ids, q, want, metric, k, 9)(iter([batch.slice(0, 700), batch.slice(700)]))]
        d = knn.distances(metric, q, base)
    assert sum(b.num_rows for b in rows) <= k * 70  # a task leaves k rows a query, whatever it reads
    got = {}
    for b in rows:
        for i, j, v in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(i, []).append((j, v))
    for i in range(70):
        fits = [j for j in range(1200) if want is None or want[i] in labels[j] or 9 in labels[j]]
        fits = [j for j in fits if d[i, j] != np.inf]
        best = sorted(fits, key=lambda j: (np.isnan(d[i, j]), 0 if np.isnan(d[i, j]) else d[i, j], j))[:k]
        mine = got.get(int(ids[i]), [])
        assert [j for j, _ in mine] == best
        assert np.array_equal([v for _, v in mine], d[i, best], equal_nan=True)
