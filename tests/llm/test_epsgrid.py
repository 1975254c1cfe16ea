"""op4 against brute force and SQL."""

import duckdb
import numpy as np
import pytest

from gridvane.llm import epsgrid, queries

from .test_simple_ops import SF

KIND = "vec_id bigint, embedding array<double>, label int, block string, n bigint, uid int"


def brute(rows, least=0.98):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    n, link = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    link[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        first = min((rows[k][0] is None, rows[k][0] or 0) for k in seen)
        first = None if first[0] else first[1]
        out.append((rows[i][0], len(link[i]), first, rows[i][0] == first))
    return out


def test_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(260):
        v = base[k % 12] + rng.normal(size=16) * rng.choice([0, 0.02, 0.08])
        rows.append((k, (v * rng.choice([1, 3])).tolist(), [0, 0, 0, 1, None][k % 5], "x", k, 1))
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [nan] * 16, 0), (903, [inf] + [1.0] * 15, 0), (904, [None] + [1.0] * 15, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (906, [1.0, 2.0], 0), (908, [-0.0, 1.0], 0), (909, [0.0, 1.0], 0), (None, [0.0, 1.0], 0), (None, [9.0, -1.0], 1), (910, [1e200, 1e200], 3), (911, [1e200, 1e200], 3)]
    rows = [(*r, *["z", 1, None][: 6 - len(r)]) for r in rows]
    monkeypatch.setattr(epsgrid, "BLOCK", 32)
    monkeypatch.setattr(epsgrid, "LEAF", 8)
    got = epsgrid.links(spark.createDataFrame(rows, KIND)).collect()
    assert [g for g in sorted(map(str, (tuple(r) for r in got)))] == sorted(map(str, brute([r for r in rows if not (r[1] and 1e200 in r[1])]) + [(910, 1, 910, True), (911, 1, 910, False)]))


def test_empty_and_sql(spark):
    assert epsgrid.links(spark.createDataFrame([], KIND)).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op4_embedding_dedup"]).fetchall()
    got = queries.op4_embedding_dedup(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("least", [0.5, 0.9, 0.98])
def test_intervals(least):
    rng = np.random.default_rng(9)
    x = epsgrid._unit(rng.normal(size=(300, 5)))
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9
    order = np.lexsort(np.floor(x / reach).T[::-1])
    x = x[order]
    got = {(i, j) for a, b in epsgrid.join_intervals(x, x[:, :3], x, x[:, :3], least, reach) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(300) for j in range(300) if x[i] @ x[j] >= least}
