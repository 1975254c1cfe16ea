"""Page layouts that are greedy: each page depends on what earlier pages used up.

A layout packs one region of nodes at a time: nodes and profile edges of a region are one Arrow
group. Without a region column there is one region, bounded by MAX_EDGES profile edges; a larger
profile has to be cut into regions (by k-means shard, by community), each with its share of the
budget, and regions are packed in parallel.

A node is pending while it is eligible (expanded, not excluded) and on no page. Pages hold `cap`
nodes. Ties go to the smallest id. Unless said otherwise hot nodes follow the pages until the budget.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDGES = 5_000_000
#: In place of a node, where a parent has less children than asked for.
NOBODY = np.iinfo(np.int64).min


class Lists:
    """(other, weight) pairs of each node as slices of arrays sorted by node; a node's are read when it is asked for."""

    def __init__(self, node: np.ndarray, other: np.ndarray, weight: np.ndarray):
        self.node, self.other, self.weight = node, other, weight

    def __getitem__(self, n: int) -> list[tuple[int, int]]:
        part = slice(np.searchsorted(self.node, n), np.searchsorted(self.node, n, "right"))
        return list(zip(self.other[part].tolist(), self.weight[part].tolist()))

    def totals(self, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, sums of their weights), of the `first` pairs of each if given."""
        at = np.flatnonzero(np.diff(self.node, prepend=self.node[:1] - 1))
        weight = self.weight if first is None else np.where(self.places() < first, self.weight, 0)
        return self.node[at], np.add.reduceat(weight, at) if len(at) else weight

    def places(self) -> np.ndarray:
        """Of each pair, its place among its node's, from 0."""
        new = np.diff(self.node, prepend=self.node[:1] - 1) != 0
        return np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)


class Both(dict):
    """node -> {other: weight of the edges of both directions}, joined when a node is asked for."""

    def __init__(self, out: Lists, into: Lists, join: Callable[[int, int], int]):
        self.sides, self.join = (out, into), join

    def __missing__(self, n: int) -> dict[int, int]:
        found: dict[int, int] = {}
        for side in self.sides:
            for other, c in side[n]:
                found[other] = self.join(found.get(other, 0), c)
        self[n] = found
        return found


def summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, with their weights added."""
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(w, at) if len(at) else w


class Packer:
    """State of one region: pending nodes, unused edges, pages so far.

    edges: (u, v, count) rows or three arrays; graph: (a, b) pairs or two arrays. Edges stay in sorted arrays, and
    only those of nodes that a layout comes to become Python objects.
    """

    def __init__(self, nodes: dict[int, int], edges: list[tuple[int, int, int]] | tuple[np.ndarray, ...], graph: set[tuple[int, int]] | tuple[np.ndarray, ...] | None, cap: int, budget: int):
        if cap < 1 or budget < 1:
            raise ValueError("page cap and budget must be positive")
        self.cap, self.budget = cap, budget
        self.heat = nodes
        self.pending = {n for n, h in nodes.items() if h > 0}
        u, v, c = edges if isinstance(edges, tuple) else np.array(edges, np.int64).reshape(-1, 3).T
        real = (c > 0) & (u != v)
        u, v, c = u[real], v[real], c[real]
        order = np.lexsort((v, -c, u))
        self.out = Lists(u[order], v[order], c[order])
        order = np.argsort(v, kind="stable")
        self.into = Lists(v[order], u[order], c[order])
        self.both: dict[int, dict[int, int]] = Both(self.out, self.into, int.__add__)
        self.arcs: dict[int, dict[int, int]] = Both(self.out, self.into, max)
        self.graph: Lists | None = None
        if graph is not None:
            x, y = graph if isinstance(graph, tuple) else np.array(list(graph), np.int64).reshape(-1, 2).T
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.argsort(x, kind="stable")
            self.graph = Lists(x[order], y[order], np.broadcast_to(np.int64(0), len(x)))
        self.adjacent: dict[int, set[int]] = {}
        self.used: set[tuple[int, int]] = set()
        self.pages: list[list[int]] = []
        self.size = 0

    @functools.cached_property
    def undirected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, weight) of all profile edges, u < v, the counts of both directions added."""
        u, v = self.out.node, self.out.other
        return summed(np.minimum(u, v), np.maximum(u, v), self.out.weight)

    @functools.cached_property
    def heaviest_of_all(self) -> int:
        return int(self.undirected[2].max(initial=0))

    def near(self, a: int, b: int) -> bool:
        if self.graph is None:
            return True
        a, b = min(a, b), max(a, b)
        if a not in self.adjacent:
            self.adjacent[a] = {x for x, _ in self.graph[a]}
        return b in self.adjacent[a]

    def full(self) -> bool:
        return self.size >= self.budget

    def hot(self) -> list[int]:
        return sorted(self.pending, key=lambda n: (-self.heat[n], n))

    def parents(self, kind: str = "out") -> list[int]:
        """Seeds by out-heat, by in-heat ("in"), or those first whose four hottest children take all ("top4")."""
        nodes, total = (self.into if kind == "in" else self.out).totals()
        if kind == "top4":
            return nodes[np.lexsort((nodes, -total, self.out.totals(4)[1] < total))].tolist()
        return nodes[np.lexsort((nodes, -total))].tolist()

    def edges(self, directed: bool = False) -> Iterator[tuple[int, int, int]]:
        """Profile edges with their weights, the heaviest first."""
        u, v, c = (self.out.node, self.out.other, self.out.weight) if directed else self.undirected
        order = np.lexsort((v, u, -c))
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            yield from zip(u[part].tolist(), v[part].tolist(), c[part].tolist())

    def emit(self, page: list[int], keep_pending: bool = False) -> None:
        page = page[: self.cap]
        if page:
            self.pages.append(page)
            self.size += len(page)
            if not keep_pending:
                self.pending.difference_update(page)

    def children(self, seed: int, n: int, page: list[int]) -> list[int]:
        kids = [v for v, _ in self.out[seed] if v in self.pending and v not in page and self.near(seed, v)]
        return kids[: max(0, n)]

    def fill(self, page: list[int], kind: str = "star", pending: bool = True) -> list[int]:
        """Adds the node with the heaviest unused edge to any member, again and again.

        star: undirected weights along graph edges; directed: profile edges either way, no graph edge
        needed; hybrid: a directed candidate if there is one, else a star one; none: nothing.
        """
        if kind == "none":
            return page
        kinds = ("directed", "star") if kind == "hybrid" else (kind,)
        heaps: dict[str, list] = {k: [] for k in kinds}

        def offer(member: int) -> None:
            for k in kinds:
                for v, c in (self.both if k == "star" else self.arcs)[member].items():
                    if (min(member, v), max(member, v)) not in self.used and v not in page and (v in self.pending or not pending) and (k != "star" or self.near(member, v)):
                        heapq.heappush(heaps[k], (-c, v, member))

        for m in page:
            offer(m)
        while len(page) < self.cap:
            got = None
            for k in kinds:
                while heaps[k] and (heaps[k][0][1] in page or (min(heaps[k][0][1:]), max(heaps[k][0][1:])) in self.used):
                    heapq.heappop(heaps[k])
                if heaps[k]:
                    got = heapq.heappop(heaps[k])[1]
                    break
            if got is None:
                return page
            if pending:
                self.used.update((min(got, m), max(got, m)) for m in page if got in self.both[m])
            page.append(got)
            offer(got)
        return page

    def path(self, ends: tuple[int, int], hops: int, page: list[int]) -> list[int]:
        """The simple path of pending nodes from either end, up to `hops` long, with the best mean weight.

        All usable steps are tried, but for ways whose mean cannot reach the best one: the next step
        weighs at most what the node's heaviest edge does, later ones what the region's heaviest does.
        """
        best, found = 0.0, []
        for end in ends:
            stack = [(end, [], 0)]
            while stack:
                at, way, total = stack.pop()
                n = len(way)
                if way and (total / n, [-x for x in way]) > (best, [-x for x in found]):
                    best, found = total / n, way
                if any((total + max(self.both[at].values(), default=0) + (m - 1) * self.heaviest_of_all) / (n + m) >= best for m in range(1, hops - n + 1)):
                    more = [(c, -v) for v, c in self.both[at].items() if v in self.pending and v not in page and v not in way and self.near(at, v)]
                    stack.extend((-v, [*way, -v], total + c) for c, v in sorted(more))
        return found


def _beam(p: Packer, seeds: list[int], beam: int, fill: str, stop: int, replica: bool = False) -> None:
    every = {n for n, h in p.heat.items() if h > 0} if replica else set()
    for s in seeds:
        if p.size >= stop:
            return
        if s not in p.pending and not (replica and p.heat.get(s, 0) > 0):
            continue
        pool = p.pending
        if replica:
            p.pending = every
        page = [s]
        page += p.children(s, min(beam - 1, p.cap - 1), page)
        p.fill(page, fill)
        if replica:
            p.pending = pool
        p.emit(page, keep_pending=replica)


def _nodes(p: Packer, hops: int, seeds: list[int], stop: int) -> None:
    for s in seeds:
        if p.size >= stop:
            return
        if s in p.pending:
            page = [s]
            page += p.children(s, min(hops - 1, p.cap - 1), page)
            p.emit(p.fill(page))


def _edge_pages(p: Packer, kind: str, stop: int, hops: int = 2) -> None:
    for u, v, _ in p.edges(directed=kind == "dir_star"):
        if p.size >= stop:
            return
        if u not in p.pending or v not in p.pending or p.cap < 2:
            continue
        page = [u, v]
        p.used.add((min(u, v), max(u, v)))
        if kind in ("star", "dir_star"):
            p.fill(page)
        elif kind in ("dir", "u"):
            while len(page) < p.cap:
                ends = (u,) if kind == "u" else (u, v)
                kids = [(-c, k) for e in ends for k, c in p.out[e] if k in p.pending and k not in page]
                if not kids:
                    break
                page.append(min(kids)[1])
        elif kind == "clique":
            grew = True
            while grew and len(page) < p.cap:
                grew = False
                near = defaultdict(int)
                for m in page:
                    for k, c in p.both[m].items():
                        if k in p.pending and k not in page:
                            near[k] += c
                for k in sorted(near, key=lambda k: (-near[k], k))[: p.cap - len(page)]:
                    page.append(k)
                    grew = True
        elif kind == "khop":
            while len(page) < p.cap and (more := p.path((u, v), hops, page)):
                page += more[: p.cap - len(page)]
        p.emit(page)


def _edge_replicas(p: Packer) -> None:
    for u, v, _ in p.edges():
        if p.full():
            return
        if p.heat.get(u, 0) > 0 and p.heat.get(v, 0) > 0:
            p.used.add((min(u, v), max(u, v)))
            page = p.fill([u, v], pending=False)
            p.emit([n for n in page if p.heat.get(n, 0) > 0], keep_pending=True)


def _duplicates(p: Packer) -> None:
    pages = list(p.pages)
    while pages and not p.full():
        for page in pages:
            if p.full():
                return
            p.emit(page, keep_pending=True)


def _hottest(p: Packer, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(the `beam` hottest children of each parent, ascending, after what it lacks of them as NOBODY; their counts added)"""
    place = p.out.places()
    hot = place < beam
    row = np.cumsum(place == 0)[hot] - 1
    nodes = np.full((len(p.out.totals()[0]), beam), NOBODY)
    nodes[row, place[hot]] = p.out.other[hot]
    nodes.sort(axis=1)
    return nodes, p.out.totals(beam)[1]


def templates_of(p: Packer, beam: int) -> Iterator[tuple[int, list[int]]]:
    """(weight, nodes): each parent's hottest children as a set; like sets are added, the heaviest come first."""
    nodes, weight = _hottest(p, beam)
    n = (nodes != NOBODY).sum(1)
    columns = np.take_along_axis(nodes, (np.arange(beam) - n[:, None]) % beam, 1).T  # what is lacking comes last, so a part of a set is before the set
    order = np.lexsort(columns[::-1])
    columns, weight, n = columns[:, order], weight[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(0)
    at = np.flatnonzero(new)
    weight = np.add.reduceat(weight, at) if len(at) else weight
    for i in np.argsort(-weight, kind="stable").tolist():
        yield int(weight[i]), columns[: n[at[i]], at[i]].tolist()


def _frontier(p: Packer, templates: Iterable[tuple[int, list[int]]]) -> None:
    """What is new of each template, in pieces of a page, goes to the first page that has room for the piece, or to a new one."""
    pages: list[list[int]] = []
    placed: set[int] = set()
    from_page = [0] * (p.cap + 1)  # by size of a piece; rooms only shrink, so the first page with room only moves on
    for _, nodes in templates:
        if len(placed) >= p.budget:
            break
        new = [n for n in nodes if n in p.pending and n not in placed]
        for a in range(0, len(new), p.cap):
            part = new[a : a + p.cap]
            i = from_page[len(part)]
            while i < len(pages) and len(pages[i]) + len(part) > p.cap:
                i += 1
            from_page[len(part)] = i
            if i == len(pages):
                pages.append([])
            pages[i] += part
            placed.update(part)
    for page in pages:
        p.emit(page)


def _frontier_pages(p: Packer, templates: Iterable[tuple[int, list[int]]]) -> None:
    for _, nodes in templates:
        if p.full():
            return
        page = [n for n in nodes if n in p.pending][: p.cap]
        if len(page) >= 2:
            p.emit(p.fill(page))


def _parents(p: Packer, star: bool) -> None:
    for s in p.parents():
        if p.full():
            return
        if s in p.pending:
            line = [s, *p.children(s, 1 << 30, [s])]
            for a in range(0, len(line), p.cap):
                page = line[a : a + p.cap]
                p.emit(p.fill(page) if star else page)


def _pct(p: Packer, share: float) -> None:
    """Unique multi-page groups: the cut on the full child list, then what is pending, then the cold rest."""
    for s in p.parents():
        if p.full():
            return
        if s not in p.pending:
            continue
        kids, total, run, k = p.out[s], sum(c for _, c in p.out[s]), 0, 0
        while k < len(kids) and (k == 0 or run / total < share):
            run += kids[k][1]
            k += 1
        first = p.cap - 1
        k = min(len(kids), first if k <= first else first + -(-(k - first) // p.cap) * p.cap)
        ready = lambda part: [v for v, _ in part if v in p.pending and v != s and p.near(s, v)]
        hot = ready(kids[:k])
        if not hot:
            continue
        for line in ([s, *hot], ready(kids[k:])):
            for a in range(0, len(line), p.cap):
                p.emit(line[a : a + p.cap])


def _cooccurrence(p: Packer, beam: int) -> Packer:
    """The same region with template co-occurrence in place of edge counts."""
    nodes, weight = _hottest(p, beam)
    found = [(nodes[:, i], nodes[:, j], weight) for i in range(beam) for j in range(i + 1, beam)]
    found = [tuple(x[f[0] != NOBODY] for x in f) for f in found]
    pairs = summed(*(np.concatenate(x) for x in zip(*found))) if found else []
    q = Packer(p.heat, pairs, None, p.cap, p.budget)
    q.pending, q.pages, q.size = p.pending, p.pages, p.size
    return q


#: Layouts that are not followed by hot nodes.
NO_APPEND = {"edge_replica", "edge_star_dup", "frontier_dup", "directed_seed_replica"}
LAYOUTS = (
    "node", "node_top4first", "edge", "edge_dir", "edge_star", "edge_u", "edge_pair", "edge_clique", "dir_edge_star", "edge_replica", "edge_star_dup",
    "frontier", "frontier_page", "frontier_dup", "frontier_topk", "cooccur_star", "dbeam_cooccur", "parent", "parent_star", "dbeam_estar_split", "directed_beam",
    "directed_beam_starfill", "directed_beam_top4first", "directed_beam_inseed", "directed_beam_tight", "directed_beam_dual", "directed_beam_hybrid", "directed_star",
    "directed_beam_pct30", "directed_beam_pct50", "directed_beam_pct80", "directed_beam_pct90", "directed_beam_pct100", "directed_seed_replica",
)


def pack(p: Packer, layout: str, beam: int = 4, hops: int = 2, top: int = 1000) -> list[list[int]]:
    """Pages of one region; slots beyond the budget are cut off the end."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    half = p.budget // 2
    match layout:
        case "node":
            _nodes(p, hops, p.hot(), p.budget)
        case "node_top4first":
            first = p.parents("top4")
            _nodes(p, hops, list(dict.fromkeys([*first, *p.hot()])), p.budget)
        case "edge":
            _edge_pages(p, "khop", p.budget, hops)
        case "edge_dir" | "edge_star" | "edge_u" | "edge_pair" | "edge_clique":
            _edge_pages(p, layout.removeprefix("edge_"), p.budget)
        case "dir_edge_star":
            _edge_pages(p, "dir_star", p.budget)
        case "edge_replica":
            _edge_replicas(p)
        case "edge_star_dup":
            _edge_pages(p, "star", p.budget)
            _duplicates(p)
        case "frontier":
            _frontier(p, templates_of(p, beam))
        case "frontier_page" | "frontier_dup":
            _frontier_pages(p, templates_of(p, beam))
            if layout == "frontier_dup":
                _duplicates(p)
        case "frontier_topk":
            _frontier_pages(p, itertools.islice(templates_of(p, beam), beam * top))
        case "cooccur_star":
            p = _cooccurrence(p, beam)
            _edge_pages(p, "star", p.budget)
        case "dbeam_cooccur":
            _beam(p, p.parents(), beam, "star", half)
            p = _cooccurrence(p, beam)
            _edge_pages(p, "star", p.budget)
        case "parent" | "parent_star":
            _parents(p, layout == "parent_star")
        case "dbeam_estar_split":
            _beam(p, p.parents(), beam, "star", half)
            _edge_pages(p, "star", p.budget)
        case "directed_beam" | "directed_beam_starfill":
            _beam(p, p.parents(), beam, "star", p.budget)
        case "directed_beam_top4first":
            _beam(p, p.parents("top4"), beam, "star", p.budget)
        case "directed_beam_inseed":
            _beam(p, p.parents("in"), beam, "star", p.budget)
        case "directed_beam_tight":
            _beam(p, p.parents(), beam, "none", p.budget)
        case "directed_beam_dual":
            _beam(p, p.parents(), beam, "star", half)
            _beam(p, p.parents("in"), beam, "star", p.budget)
        case "directed_beam_hybrid":
            _beam(p, p.parents(), beam, "hybrid", p.budget)
        case "directed_star":
            _beam(p, p.parents(), beam, "directed", p.budget)
        case "directed_seed_replica":
            _beam(p, p.parents(), beam, "star", p.budget, replica=True)
        case _:
            _pct(p, int(layout.removeprefix("directed_beam_pct")) / 100)
    if layout not in NO_APPEND and not p.full():
        rest = p.hot()[: p.budget - p.size]
        for a in range(0, len(rest), p.cap):
            p.emit(rest[a : a + p.cap])
    over = p.size - p.budget
    while over > 0:
        last = p.pages.pop()
        if len(last) > over:
            p.pages.append(last[: len(last) - over])
        over -= len(last)
    return p.pages


def greedy_layout(layout: str, node_profile: DataFrame, edge_profile: DataFrame, cap: int, budget: int, graph: DataFrame | None = None, excluded: DataFrame | None = None, beam: int = 4, hops: int = 2) -> DataFrame:
    """(region, page, slot, id) of a layout of node_profile(id, n_expand[, region]) and edge_profile(u, v, cnt).

    budget: slots of a region. graph(src, dst): edges that star fills and children must follow.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    nodes = node_profile if "region" in node_profile.columns else node_profile.withColumn("region", F.lit(0))
    nodes = nodes.join(excluded.select("id"), "id", "left_anti") if excluded is not None else nodes
    where = nodes.select("id", "region")

    def inside(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose ends are in one region."""
        x = pairs.join(where.toDF("a", "region"), "a").join(where.toDF("b", "region_b"), "b")
        return x.where("region = region_b").drop("region_b")

    rows = nodes.select(F.col("region").cast("int"), F.lit(0).cast("tinyint").alias("what"), F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("n_expand").cast("bigint").alias("n"))
    links = inside(edge_profile.toDF("a", "b", "n")).select(F.col("region").cast("int").alias("region"), F.lit(1).cast("tinyint").alias("what"), "a", "b", F.col("n").cast("bigint").alias("n"))
    rows = rows.unionByName(links)
    if graph is not None:
        rows = rows.unionByName(inside(graph.select("src", "dst").toDF("a", "b")).select(F.col("region").cast("int").alias("region"), F.lit(2).cast("tinyint").alias("what"), "a", "b", F.lit(0).cast("bigint").alias("n")))
    with_graph = graph is not None

    def run(table: pa.Table) -> pa.Table:
        what, a, b, n = (table.column(c).to_numpy() for c in ("what", "a", "b", "n"))
        if (what == 1).sum() > MAX_EDGES:
            raise ValueError(f"a region has more than {MAX_EDGES} profile edges: cut it into smaller ones")
        pairs = (a[what == 2], b[what == 2]) if with_graph else None
        p = Packer(dict(zip(a[what == 0].tolist(), n[what == 0].tolist())), (a[what == 1], b[what == 1], n[what == 1]), pairs, cap, budget)
        pages = pack(p, layout, beam, hops)
        flat = [(i, s, x) for i, page in enumerate(pages) for s, x in enumerate(page)]
        region = table.column("region")[0].as_py()
        return pa.table([pa.array([region] * len(flat), pa.int32()), pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.int64())], names=["region", "page", "slot", "id"])

    return rows.groupBy("region").applyInArrow(run, "region int, page bigint, slot bigint, id bigint")


def relayout(layout: str, node_profile: DataFrame, edge_profile: DataFrame, cap: int, graph: DataFrame | None = None) -> DataFrame:
    """(new_id, old_id) for the whole base: pages of the layout over all nodes, then the rest by heat and id."""
    from .layouts import permutation

    pages = greedy_layout(layout, node_profile, edge_profile, cap, max(1, node_profile.count()), graph)
    listed = pages.groupBy("region", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "id"))), lambda s: s["id"]).alias("nodes"))
    listed = listed.select((F.col("region").cast("bigint") * (1 << 40) + F.col("page")).alias("page_seq"), "nodes")
    return permutation(listed, node_profile, node_profile)


def set_cover(wanted: set[int], sectors: dict[int, set[int]], cached: set[int] = frozenset()) -> list[int]:
    """Sectors that cover the wanted ids: each time the one with most that are missing, a cached one of equals, then the lowest."""
    chosen, missing = [], set(wanted)
    while missing:
        best = min(sectors, key=lambda s: (-len(sectors[s] & missing), s not in cached, s), default=None)
        if best is None or not sectors[best] & missing:
            break
        chosen.append(best)
        missing -= sectors[best]
    return chosen


def cover_sectors(requests: DataFrame, replicas: DataFrame) -> DataFrame:
    """(query_id, sectors, n_missing) of requests(query_id, id) over replicas(sector, id), by set cover in each query."""
    x = requests.join(replicas, "id", "left").select("query_id", "id", "sector")

    def run(table: pa.Table) -> pa.Table:
        has: dict[int, set[int]] = defaultdict(set)
        ids, where = table.column("id").to_pylist(), table.column("sector").to_pylist()
        for i, s in zip(ids, where):
            if s is not None:
                has[s].add(i)
        chosen = set_cover(set(ids), has)
        missing = set(ids) - set().union(*(has[s] for s in chosen))
        return pa.table([table.column("query_id")[:1], pa.array([chosen], pa.list_(pa.int64())), pa.array([len(missing)], pa.int64())], names=["query_id", "sectors", "n_missing"])

    return x.groupBy("query_id").applyInArrow(run, "query_id bigint, sectors array<bigint>, n_missing bigint")
