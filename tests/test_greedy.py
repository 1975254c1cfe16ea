"""Greedy layouts: budget, page cap, uniqueness, seeds."""

import numpy as np
import pytest

from gridvane.plans import greedy


@pytest.fixture(scope="module")
def region():
    rng = np.random.default_rng(5)
    edges = {}
    for u in range(120):
        for v in rng.choice(120, 8, replace=False):
            if u != v:
                edges[u, int(v)] = int(rng.integers(1, 30))
    heat = {n: sum(c for (_, v), c in edges.items() if v == n) for n in range(120)}
    return heat, [(u, v, c) for (u, v), c in edges.items()]


@pytest.mark.parametrize("layout", greedy.LAYOUTS)
def test_invariants(region, layout):
    heat, edges = region
    graph = {(min(u, v), max(u, v)) for u, v, _ in edges}
    for budget in (7, 60, 110):
        pages = greedy.pack(greedy.Packer(heat, edges, graph, 5, budget), layout)
        flat = [n for p in pages for n in p]
        assert all(0 < len(p) <= 5 and len(set(p)) == len(p) for p in pages) and len(flat) == budget
        if layout not in greedy.NO_APPEND:
            assert len(set(flat)) == len(flat)
        assert all(heat[n] > 0 for n in flat)


def test_rules(region):
    heat, edges = region
    first = greedy.pack(greedy.Packer(heat, edges, None, 5, 50), "directed_beam")[0]
    total = {}
    for u, _, c in edges:
        total[u] = total.get(u, 0) + c
    assert first[0] == min(total, key=lambda u: (-total[u], u))
    kids = sorted(((-c, v) for u, v, c in edges if u == first[0]))
    assert first[1:4] == [v for _, v in kids[:3]]
    assert greedy.pack(greedy.Packer(heat, edges, None, 5, 60), "directed_beam") == greedy.pack(greedy.Packer(heat, edges, None, 5, 60), "directed_beam_starfill")
    both = {}
    for u, v, c in edges:
        both[min(u, v), max(u, v)] = both.get((min(u, v), max(u, v)), 0) + c
    assert tuple(greedy.pack(greedy.Packer(heat, edges, None, 5, 50), "edge_star")[0][:2]) == min(both, key=lambda e: (-both[e], e))
    hot = sorted(heat, key=lambda n: (-heat[n], n))
    assert greedy.pack(greedy.Packer(heat, [], None, 5, 20), "node")[0][0] == hot[0]
    with pytest.raises(ValueError):
        greedy.pack(greedy.Packer(heat, edges, None, 5, 10), "no")


def test_tables(spark, region):
    heat, edges = region
    nodes = spark.createDataFrame([(n, h, n % 2) for n, h in heat.items()], "id bigint, n_expand bigint, region int")
    ep = spark.createDataFrame(edges, "u bigint, v bigint, cnt bigint")
    out = greedy.greedy_layout("directed_beam", nodes, ep, 5, 40).collect()
    assert {r.region for r in out} == {0, 1} and all(r.id % 2 == r.region for r in out) and len(out) == 80
    perm = greedy.relayout("edge_star", nodes.drop("region"), ep, 5).collect()
    assert sorted(r.new_id for r in perm) == sorted(r.old_id for r in perm) == list(range(120))
    wanted = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 9)], "query_id bigint, id bigint")
    where = spark.createDataFrame([(7, 1), (7, 2), (5, 3), (6, 3), (4, 1)], "sector bigint, id bigint")
    assert [tuple(r) for r in greedy.cover_sectors(wanted, where).collect()] == [(1, [7, 5], 1)]
    assert greedy.set_cover({3}, {5: {3}, 6: {3}}, {6}) == [6]


def test_best_path_tries_all_neighbours():
    """A light first step before a heavy second one, behind eight heavier edges of which some are placed."""
    spokes = [(0, v, 20 + v) for v in range(2, 12)]
    p = greedy.Packer({n: 1 for n in range(15)}, [(0, 1, 50), *spokes, (0, 12, 1), (12, 13, 500)], None, 5, 15)
    assert p.path((0, 1), 2, [0, 1]) == [12, 13]
    p.pending -= set(range(2, 12))
    p.pending -= {13}
    assert p.path((0, 1), 2, [0, 1]) == [12]


def test_best_path_like_brute_force(region):
    heat, edges = region
    for hops in (1, 2, 3):
        p = greedy.Packer(heat, edges, None, 5, 60)
        p.pending -= set(range(0, 120, 4))
        for u, v, _ in edges[:20]:
            ways, level = [], [((e,), 0) for e in (u, v)]
            for _ in range(hops):
                level = [((*w, x), t + c) for w, t in level for x, c in p.both[w[-1]].items() if x in p.pending and x not in (u, v) and x not in w]
                ways += level
            want = max(((t / (len(w) - 1), [-x for x in w[1:]]) for w, t in ways), default=(0, []))[1]
            assert p.path((u, v), hops, [u, v]) == [-x for x in want]


def test_frontier_is_first_fit():
    """Against a plain scan of all pages for each piece."""
    import random

    rng = random.Random(2)
    for _ in range(50):
        cap, budget = rng.randint(1, 6), rng.choice([10, 1000])
        templates = [(1, rng.sample(range(60), rng.randint(1, 10))) for _ in range(30)]
        eligible = set(rng.sample(range(60), 50))
        out = []

        class Pages:
            pending = eligible

            def __init__(self):
                self.cap, self.budget = cap, budget

            def emit(self, page):
                out.append(list(page))

        greedy._frontier(Pages(), templates)
        pages, seen = [], set()
        for _, nodes in templates:
            if len(seen) >= budget:
                break
            new = [n for n in nodes if n in eligible and n not in seen]
            for a in range(0, len(new), cap):
                part = new[a : a + cap]
                page = next((p for p in pages if len(p) + len(part) <= cap), None)
                if page is None:
                    pages.append(page := [])
                page += part
                seen.update(part)
        assert out == pages
