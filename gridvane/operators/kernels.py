"""Graph-search kernels over numpy arrays: one shard of an index at a time.

A shard is vectors (n, d) and an adjacency matrix (n, degree) of local numbers, padded with -1.
Distances here are float32 matrix products, which only rank candidates; callers measure what they
return in double.
"""

from __future__ import annotations

import math

import numpy as np

#: Points from which a label's start is chosen.
STARTS = 25


def pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) distances by one matrix product; cosine expects unit vectors."""
    dots = a @ b.T
    if metric == "ip":
        return -dots
    if metric == "cosine":
        return 1 - dots
    if metric == "fast_l2":  # squared distances without the norm of a, which rank alike
        return (b * b).sum(1)[None, :] - 2 * dots
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * dots)


def greedy_search(query: np.ndarray, x: np.ndarray, nbrs: np.ndarray, starts: np.ndarray, width: int, metric: str = "l2", allowed: np.ndarray | None = None, measure=None, beam: int = 1, io_limit: int = 0, seeds: np.ndarray | None = None, pool: int = 0):
    """Best-first search: (numbers by distance, distances, expanded numbers, hops, comparisons).

    Keeps the `width` nearest found and expands the `beam` nearest unexpanded ones at a time until
    none is left. allowed: nodes that may be found at all (labels are checked before distances).
    measure(ids) gives distances of nodes (a quantised guide), else the vectors are compared. seeds: of
    each node, whose pages it lies on; a beam then prefers nodes that lie together (see seed_beam),
    among the `pool` nearest unexpanded ones.
    """
    measure = measure or (lambda ids: pairwise(metric, query[None, :], x[ids])[0])
    seen = np.zeros(len(x), bool)
    starts = np.unique(starts)
    starts = starts[allowed[starts]] if allowed is not None else starts
    seen[starts] = True
    ids, dist = starts, measure(starts) if len(starts) else np.zeros(0)
    order = np.lexsort((ids, dist))[:width]
    ids, dist, done = ids[order], dist[order], np.zeros(len(order), bool)
    expanded, hops, compared = [], 0, len(starts)
    while not done.all():
        if io_limit and len(expanded) >= io_limit:
            break
        take = np.flatnonzero(~done)
        take = take[:beam] if seeds is None else take[seed_beam(seeds[ids[take]], beam, pool or 2 * beam)]
        done[take] = True
        expanded.extend(ids[take].tolist())
        hops += 1
        near = nbrs[ids[take]].ravel()
        near = np.unique(near[near >= 0])
        near = near[~seen[near]]
        seen[near] = True
        near = near[allowed[near]] if allowed is not None else near
        if not len(near):
            continue
        compared += len(near)
        ids, dist, done = np.concatenate([ids, near]), np.concatenate([dist, measure(near)]), np.concatenate([done, np.zeros(len(near), bool)])
        order = np.lexsort((ids, dist))[:width]
        ids, dist, done = ids[order], dist[order], done[order]
    return ids, dist, np.array(expanded, np.int64), hops, compared


def seed_beam(seeds: np.ndarray, beam: int, pool: int) -> np.ndarray:
    """Places of up to `beam` of the first `pool` nodes, given the seeds of nodes by distance.

    The nearest is taken, then each time the nearest of those whose seed one of the taken has, else
    the nearest of all: what is read together is expanded together.
    """
    left, taken, met = list(range(min(pool, len(seeds)))), [], set()
    while left and len(taken) < beam:
        at = next((i for i in left if seeds[i] in met), left[0])
        left.remove(at)
        taken.append(at)
        met.add(seeds[at])
    return np.array(taken, np.int64)


def nearest_of_seeds(dist: np.ndarray, done: np.ndarray, seeds: np.ndarray, preferred: set, slack: float) -> int:
    """The place to expand next in a list by distance: -1 if all is expanded.

    Of the open nodes from the nearest one on, up to the next expanded one and within `slack` of its
    distance, the nearest whose seed is preferred; the nearest open node if there is none.
    """
    open_ = np.flatnonzero(~done)
    if not len(open_):
        return -1
    first = open_[0]
    after = np.flatnonzero(done[first:])
    run = np.arange(first, first + after[0] if len(after) else len(dist))
    run = run[dist[run] <= dist[first] + slack]
    return int(next((i for i in run if seeds[i] in preferred), first))


def open_of_seeds(ids: np.ndarray, done: np.ndarray, seeds: np.ndarray, wanted: set, without: set) -> np.ndarray:
    """The open nodes whose seed is wanted, but for those in `without`, in the order of the list."""
    return np.array([i for i, d, s in zip(ids.tolist(), done.tolist(), seeds.tolist()) if not d and s in wanted and i not in without], np.int64)


def robust_prune(pool: np.ndarray, dist: np.ndarray, x: np.ndarray, degree: int, alpha: float = 1.2, most: int = 750, metric: str = "l2", labels: list[frozenset] | None = None, own: frozenset | None = None, saturate: bool = False) -> np.ndarray:
    """At most `degree` of the pool, nearest first, none that a chosen one shadows.

    A candidate c is shadowed by a chosen s when d(p, c) > a * d(s, c); a starts at 1 and grows by 1.2
    up to alpha while there is room, and what an earlier round shadowed may then come in. With labels,
    s shadows c only if it has every label that c shares with the point (own). saturate: where alpha is
    above 1, places that are left go to the nearest of the pool that are not chosen.
    """
    order = np.lexsort((pool, dist))[:most]
    pool, dist = pool[order], dist[order].astype(np.float64)
    if len(pool) <= 1:
        return pool[:degree]
    shadow = np.zeros(len(pool))
    chosen: list[int] = []
    picked = np.zeros(len(pool), bool)
    level = 1.0
    between = pairwise(metric, x[pool], x[pool])
    if labels is not None:  # of each candidate, which of the point's labels it has
        have = np.array([[v in labels[c] for v in own] for c in pool], bool).reshape(len(pool), -1)
    while level <= alpha + 1e-9 and len(chosen) < degree:
        for i in range(len(pool)):
            if len(chosen) >= degree:
                break
            if picked[i] or shadow[i] > level:
                continue
            picked[i] = True
            chosen.append(i)
            gap = between[i]
            if metric == "ip":  # products: shadowed if more alike to the chosen one than to the point
                ratio = np.where(-gap > level * -dist, np.inf, 0.0)
            else:
                ratio = np.where(gap > 0, dist / np.maximum(gap, 1e-30), np.inf)
            if labels is not None:
                ratio = np.where((have & ~have[i]).any(1), 0.0, ratio)
            shadow[i + 1 :] = np.maximum(shadow[i + 1 :], ratio[i + 1 :])
        level *= 1.2
    if saturate and alpha > 1 and len(chosen) < degree:
        chosen += np.flatnonzero(~picked)[: degree - len(chosen)].tolist()
    return pool[chosen]


def padded(lists: list[np.ndarray], degree: int) -> np.ndarray:
    out = np.full((len(lists), max(1, degree)), -1, np.int64)
    for i, v in enumerate(lists):
        out[i, : min(len(v), degree)] = v[:degree]
    return out


#: Numbers of the distances among candidates that prune() holds at once.
PRUNED_AT_ONCE = 1 << 22


def prune(points: np.ndarray, pools: list[np.ndarray], x: np.ndarray, degree: int, alpha: float = 1.2, most: int = 750, metric: str = "l2", labels: Sharing | None = None, saturate: bool = False) -> list[np.ndarray]:
    """robust_prune() of a pool for each of some points, many together: points of like pools share the matrix products and the steps.

    A pool names each of its nodes once. labels: of all nodes of x.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(points)
    sizes = np.array([len(v) for v in pools], np.int64)
    order = np.argsort(sizes, kind="stable")
    end = len(order)
    while end > 0:
        widest = max(1, int(sizes[order[end - 1]]))
        begin = max(0, end - max(1, PRUNED_AT_ONCE // max(widest, x.shape[1]) // widest))
        some = order[begin:end]
        for i, v in zip(some.tolist(), _prune(points[some], [pools[i] for i in some], sizes[some], x, degree, alpha, most, metric, labels, saturate)):
            out[i] = v
        end = begin
    return out


def _prune(points, pools, sizes, x, degree, alpha, most, metric, labels, saturate) -> list[np.ndarray]:
    n, wide = len(points), int(sizes.max(initial=0))
    if not wide:
        return list(pools)
    real = np.arange(wide) < sizes[:, None]
    pool = np.full((n, wide), np.iinfo(np.int64).max)
    pool[real] = np.concatenate(pools)
    at = np.where(real, pool, 0)
    own = x[points]
    dots = np.matmul(x[at], own[:, :, None])[:, :, 0]
    norms = (x * x).sum(1) if metric == "l2" else np.zeros(0, x.dtype)
    dist = -dots if metric == "ip" else 1 - dots if metric == "cosine" else np.maximum(0, norms[points][:, None] + norms[at] - 2 * dots)
    dist = np.where(real, dist, np.inf)
    nearest = np.lexsort((pool, dist))[:, :most]
    pool, dist, real = (np.take_along_axis(v, nearest, 1) for v in (pool, dist.astype(np.float64), real))
    wide = pool.shape[1]
    at = np.where(real, pool, 0)
    near = x[at]
    between = np.matmul(near, near.transpose(0, 2, 1))
    between = -between if metric == "ip" else 1 - between if metric == "cosine" else np.maximum(0, norms[at][:, :, None] + norms[at][:, None, :] - 2 * between)
    have = labels.bits[at] & labels.bits[points][:, None, :] if labels is not None else None  # which of the point's labels a candidate has
    shadow, picked, column = np.zeros((n, wide)), ~real, np.arange(wide)
    chosen, count = np.zeros((n, degree), np.int64), np.zeros(n, np.int64)
    level, place, rows = np.ones(n), np.zeros(n, np.int64), np.arange(n)
    dist[~real] = 0
    while len(rows):
        free = ~picked[rows] & (shadow[rows] <= level[rows, None]) & (column >= place[rows, None])
        first = free.argmax(1)
        any_ = free[np.arange(len(rows)), first]
        late = rows[~any_]  # nobody is left at this level
        level[late] *= 1.2
        place[late] = 0
        r, i = rows[any_], first[any_]
        picked[r, i] = True
        chosen[r, count[r]] = i
        count[r] += 1
        place[r] = i + 1
        gap = between[r, i]
        if metric == "ip":
            ratio = np.where(-gap > level[r, None] * -dist[r], np.inf, 0.0)
        else:
            ratio = np.where(gap > 0, dist[r] / np.maximum(gap, 1e-30), np.inf)
        if have is not None:
            ratio[(have[r] & ~have[r, i][:, None, :]).any(2)] = 0.0
        shadow[r] = np.where(column > i[:, None], np.maximum(shadow[r], ratio), shadow[r])
        rows = rows[(count[rows] < degree) & (level[rows] <= alpha + 1e-9)]
    out = []
    for i in range(n):
        taken = chosen[i, : count[i]]
        if saturate and alpha > 1 and count[i] < degree and sizes[i] > 1:
            taken = np.concatenate([taken, np.flatnonzero(~picked[i])[: degree - count[i]]])
        out.append(pool[i, taken])
    return out


def add_back_edges(lists: list[np.ndarray], changed: np.ndarray, x: np.ndarray, degree: int, alpha: float, metric: str, slack: float = 1.3, labels: Sharing | None = None) -> list[int]:
    """Gives each neighbour of the changed nodes an edge back; beyond slack * degree, a node is pruned anew. Returns the nodes that got one."""
    n = len(x)
    to, back = np.concatenate([lists[i] for i in changed] or [np.zeros(0, np.int64)]), np.repeat(changed, [len(lists[i]) for i in changed])
    nodes = np.unique(to)
    have = np.concatenate([lists[j] for j in nodes] or [np.zeros(0, np.int64)]) + np.repeat(nodes, [len(lists[j]) for j in nodes]) * n
    new = np.setdiff1d((to * n + back)[to != back], have)
    got, at = np.unique(new // n, return_index=True)
    got = got.tolist()
    long = []
    for j, more in zip(got, np.split(new % n, at[1:])):
        lists[j] = np.concatenate([lists[j], more])
        if len(lists[j]) > slack * degree:
            long.append(j)
    for j, kept in zip(long, prune(np.array(long, np.int64), [lists[j] for j in long], x, degree, alpha, metric=metric, labels=labels)):
        lists[j] = kept
    return got


def stepped(points: np.ndarray, x: np.ndarray, nbrs: np.ndarray, starts: np.ndarray, width: int, metric: str = "l2", allowed: np.ndarray | None = None):
    """Best-first searches for some points in step: (numbers by distance, -1 after the last; their distances; (searches, nodes) that were expanded; hops; comparisons).

    starts: a row of distinct nodes for each search, padded with -1. As greedy_search with a beam of one, but of
    nodes at the same distance the one that was met first is the nearer. allowed: of all searches, or a row for each.
    """
    n, m = len(points), len(x)
    norms = (x * x).sum(1) if metric in ("l2", "fast_l2") else None
    own = (points * points).sum(1)

    def measure(r: np.ndarray, node: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", x[node], points[r])
        if metric == "ip":
            return -dots
        if metric == "cosine":
            return 1 - dots
        return norms[node] - 2 * dots if metric == "fast_l2" else np.maximum(0, norms[node] - 2 * dots + own[r])

    seen = np.zeros((n, m), bool) if allowed is None else np.array(np.broadcast_to(~allowed, (n, m)))
    ids, dist = np.full((n, max(width, starts.shape[1])), -1, np.int64), np.full((n, max(width, starts.shape[1])), np.inf, np.float32)
    real = (starts >= 0) & ~seen[np.arange(n)[:, None], starts]
    r, c = np.nonzero(real)
    seen[r, starts[r, c]] = True
    ids[r, c] = starts[r, c]
    dist[r, c] = measure(r, starts[r, c])
    order = np.argsort(dist, axis=1, kind="stable")[:, :width]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    hops, compared, went = np.zeros(n, np.int64), real.sum(1), []
    rows = np.flatnonzero(~done.all(1))
    while len(rows):
        take = np.argmin(done[rows], axis=1)  # lists are sorted, so the first open one is the nearest
        node = ids[rows, take]
        done[rows, take] = True
        hops[rows] += 1
        went.append((rows, node))
        near = nbrs[node]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        r_all, met = rows[r], near[r, c]
        seen[r_all, met] = True
        compared[rows] += fresh.sum(1)
        d = measure(r_all, met)
        keep = d < dist[r_all, -1]  # the others are beyond a full list
        keep |= ids[r_all, -1] < 0
        r, r_all, met, d = r[keep], r_all[keep], met[keep], d[keep]
        if len(r):
            some, first, count = np.unique(r, return_index=True, return_counts=True)
            line, place = np.repeat(np.arange(len(some)), count), np.arange(len(r)) - np.repeat(first, count) + width
            some, shape = rows[some], (len(some), width + int(count.max()))
            all_d, all_i, all_done = np.full(shape, np.inf, np.float32), np.full(shape, -1), np.ones(shape, bool)
            all_d[:, :width], all_i[:, :width], all_done[:, :width] = dist[some], ids[some], done[some]
            all_d[line, place], all_i[line, place], all_done[line, place] = d, met, False
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist[some], ids[some], done[some] = (np.take_along_axis(v, order, 1) for v in (all_d, all_i, all_done))
        rows = rows[~done[rows].all(1)]
    went = tuple(np.concatenate(v) for v in zip(*went)) if went else (np.zeros(0, np.int64),) * 2
    return ids, dist, went, hops, compared


def visited(points: np.ndarray, x: np.ndarray, nbrs: np.ndarray, starts: np.ndarray, width: int, metric: str = "l2") -> list[np.ndarray]:
    """The nodes that a best-first search for each of the points expands, ascending; starts: one entry for each search."""
    _, _, (row, node), hops, _ = stepped(points, x, nbrs, starts[:, None], width, metric)
    return np.split(node[np.lexsort((node, row))], np.cumsum(hops)[:-1])


def walked(dist: np.ndarray, nbrs: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best-first searches of one shard in step, a row of `dist` (queries, nodes) for each: (numbers by distance, which of these the list holds in the end, hops, comparisons).

    As greedy_search with a beam of one. The nodes stand in the order of their distance, so the next to be expanded is
    the first open one, and a search ends when `width` nearer ones were met.
    """
    q, n = dist.shape
    order = np.argsort(dist, axis=1, kind="stable")
    rank = np.full((q, n + 1), n)  # what pads the lists, -1, is the last place
    np.put_along_axis(rank, order, np.arange(n)[None, :], 1)
    seen, open_ = np.zeros((q, n + 1), bool), np.zeros((q, n + 1), bool)
    first = rank[:, np.unique(starts)]
    np.put_along_axis(seen, first, True, 1)
    np.put_along_axis(open_, first, True, 1)
    seen[:, n] = True
    met, opened, places, hops, rows = seen.ravel(), open_.ravel(), rank.ravel(), np.zeros(q, np.int64), np.arange(q)
    while len(rows):
        at = open_[rows].argmax(1)
        go = opened[rows * (n + 1) + at]
        late = np.flatnonzero(go & (hops[rows] >= width))  # before that, not so many can be nearer
        if len(late):
            go[late] = (seen[rows[late]] & (np.arange(n + 1) < at[late, None])).sum(1) < width
        rows, at = rows[go], at[go]
        opened[rows * (n + 1) + at] = False
        hops[rows] += 1
        near = nbrs[order[rows, at]]
        where = (rows * (n + 1))[:, None] + places.take((rows * (n + 1))[:, None] + np.where(near < 0, n, near))
        where = where[~met.take(where)]
        met[where] = opened[where] = True
    seen = seen[:, :n]
    return order, seen & (np.cumsum(seen, 1) <= width), hops, seen.sum(1)


def medoid_of(x: np.ndarray) -> int:
    return int(((x - x.mean(0)) ** 2).sum(1).argmin())


def build(x: np.ndarray, degree: int, width: int, alpha: float = 1.2, metric: str = "l2", seed: int = 0, pool: int | None = None, labels: list[frozenset] | None = None, start: int | None = None) -> tuple[np.ndarray, int]:
    """(adjacency, start) of one shard; the start is the medoid unless it is given.

    First each point's pool is its exact nearest neighbours (blocks of matrix products) and some random
    points as far reach; pools are pruned, edges get their way back. Then every point is searched for in
    that graph, and what the search expands is pruned with the point's neighbours, so that lists lead to
    their points; lists keep places for `degree` and long ones are pruned again. With labels the graph is
    a filtered one: the pool also has the nearest points that share a label, shadowing minds
    the labels.
    Everything reachable from the medoid: a component that is not gets an edge from its nearest
    reachable point.
    """
    n = len(x)
    if n == 1:
        return np.full((1, max(1, degree)), -1, np.int64), 0
    rng = np.random.default_rng(seed)
    take = min(n - 1, pool or max(width, 2 * degree))
    far = rng.integers(0, n, (n, min(n - 1, max(4, degree // 4))))
    lists: list[np.ndarray] = []
    shares = Sharing(labels) if labels is not None else None
    members = members_of(labels) if labels is not None else {}
    some = lambda points, pools: prune(points, pools, x, degree, alpha, metric=metric, labels=shares, saturate=True)
    for a in range(0, n, 512):
        d = pairwise(metric, x[a : a + 512], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.concatenate([np.argpartition(d, take - 1, axis=1)[:, :take], far[a : a + len(d)]], 1)
        pools = []
        for i in range(len(d)):
            ids = np.unique(near[i] if labels is None else np.concatenate([near[i], _sharing(d[i], members, labels[a + i], take)]))
            pools.append(ids[ids != a + i])
        lists += some(np.arange(a, a + len(d)), pools)
    add_back_edges(lists, np.arange(n), x, degree, alpha, metric, labels=shares)
    start = medoid_of(x) if start is None else start
    graph = padded(lists, math.ceil(1.3 * degree))
    step = max(1, min(512, (1 << 26) // (2 * n)))
    for a in range(0, n, step):
        part = np.arange(a, min(n, a + step))
        pools = []
        for i, found in zip(part.tolist(), visited(x[part], x, graph, np.full(len(part), start), width, metric)):
            ids = np.union1d(found, lists[i])
            pools.append(ids[ids != i])
        lists[a : a + len(part)] = some(part, pools)
    add_back_edges(lists, np.arange(n), x, degree, alpha, metric, labels=shares)
    long = np.flatnonzero([len(v) > degree for v in lists])
    for i, kept in zip(long.tolist(), some(long, [lists[i] for i in long])):
        lists[i] = kept
    _connect(lists, start, x, degree, metric)
    return padded(lists, degree), start


def _sharing(dist: np.ndarray, members: dict, own: frozenset, most: int) -> np.ndarray:
    """Of each label of a point, the nearest points that have it."""
    found = [np.zeros(0, np.int64)]
    for v in own:
        m = members[v]
        found.append(m if len(m) <= most else m[np.argpartition(dist[m], most - 1)[:most]])
    return np.unique(np.concatenate(found))


def _connect(lists: list[np.ndarray], start: int, x: np.ndarray, degree: int, metric: str) -> None:
    reached, length = np.zeros(len(lists), bool), np.array([len(v) for v in lists])
    norms = (x * x).sum(1) if metric == "l2" else None
    todo = [start]
    reached[start] = True
    while True:
        while todo:
            new = lists[todo.pop()]
            new = new[~reached[new]]
            reached[new] = True
            todo.extend(new.tolist())
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        room = reached & (length < degree)
        d = pairwise(metric, x[lost[:1]], x)[0] if norms is None else norms - 2 * (x @ x[lost[0]])
        near = int(np.where(room if room.any() else reached, d, np.inf).argmin())
        lists[near] = np.append(lists[near][: degree - 1], lost[0]) if len(lists[near]) >= degree else np.append(lists[near], lost[0])
        length[near] = len(lists[near])
        reached[lost[0]] = True
        todo = [int(lost[0])]


class Sharing:
    """Indexed by points, says which of them have one of the labels `own`; labels are bits of a row."""

    def __init__(self, labels: list[frozenset]):
        self.number = {v: i for i, v in enumerate(sorted(set().union(*labels)))}
        self.bits = np.zeros((len(labels), len(self.number) // 64 + 1), np.uint64)
        for i, own in enumerate(labels):
            self.bits[i] = self._row(own)
        self.own = self.bits[:1]

    def _row(self, labels: frozenset) -> np.ndarray:
        row = np.zeros(self.bits.shape[1], np.uint64)
        for v in labels:
            row[self.number[v] >> 6] |= np.uint64(1) << np.uint64(self.number[v] & 63)
        return row

    def of(self, labels: frozenset) -> Sharing:
        self.own = self._row(labels)
        return self

    def __getitem__(self, points: np.ndarray) -> np.ndarray:
        return (self.bits[points] & self.own).any(1)


#: Points that insert() links together, at most.
INSERTED = 64


def insert(x: np.ndarray, lists: list[np.ndarray], first: int, starts: np.ndarray, degree: int, width: int, alpha: float, metric: str, labels: list[frozenset] | None = None) -> np.ndarray:
    """Links the points from number `first` on into the graph of those before; returns the older points whose lists changed.

    Few points at a time (a 32nd of those before at most) are searched for in step; each also has all of these that come
    before it as candidates, which it would have met had they been linked one after another.
    With labels a point is also searched for among the points that share one, from the starts of its
    labels, and pruning minds them. Only the rows of the neighbour matrix that change are written.
    """
    n, width_of = len(x), math.ceil(1.3 * degree) + 1
    graph = np.full((n, max([width_of, *map(len, lists)])), -1, np.int64)
    graph[: len(lists)] = padded(lists, graph.shape[1])
    shares = Sharing(labels) if labels is not None else None
    entry = label_starts(members_of(labels[:first]), first) if labels is not None else {}
    changed = np.zeros(n, bool)

    def write(i: int) -> None:
        graph[i] = -1
        graph[i, : len(lists[i])] = lists[i]
        changed[i] = True

    def found(part: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None) -> list[np.ndarray]:
        """Of each of the points, what its search has on its list in the end and what it expands."""
        ids, _, (row, node), _, _ = stepped(x[part], x[: part[0]], graph, entries, width, metric, allowed)
        r, c = np.nonzero(ids >= 0)
        keys = np.unique(np.concatenate([r, row]) * n + np.concatenate([ids[r, c], node]))
        return np.split(keys % n, np.searchsorted(keys // n, np.arange(1, len(part))))

    p = first
    while p < n:
        part = np.arange(p, min(n, p + max(1, min(INSERTED, p // 32))))
        pools = found(part, np.broadcast_to(np.unique(starts), (len(part), len(np.unique(starts)))))
        if labels is not None:
            known = [np.unique([entry[v] for v in labels[i] if v in entry]).astype(np.int64) for i in part]
            entries = padded(known, max(map(len, known)))
            same = (shares.bits[None, :p] & shares.bits[part][:, None, :]).any(2)
            pools = [np.union1d(a, b) for a, b in zip(pools, found(part, entries, same))]
            for i in part.tolist():
                for v in labels[i]:
                    entry.setdefault(v, i)
        pools = [np.concatenate([pool, part[:i]]) for i, pool in enumerate(pools)]
        lists += prune(part, pools, x, degree, alpha, metric=metric, labels=shares, saturate=labels is not None)
        for i in part.tolist():
            write(i)
        for j in add_back_edges(lists, part, x, degree, alpha, metric, labels=shares):
            write(j)
        p += len(part)
    return np.flatnonzero(changed[:first])


def drop(lists: list[np.ndarray], dead: np.ndarray, x: np.ndarray, degree: int, alpha: float, metric: str, labels: list[frozenset] | None = None) -> list[np.ndarray]:
    """Lists after deletion: a dead neighbour is replaced by its live ones; too many are pruned, minding the labels if they are given."""
    out, long = [], []
    for i, own in enumerate(lists):
        if dead[i]:
            out.append(np.zeros(0, np.int64))
            continue
        gone = own[dead[own]]
        keep = own[~dead[own]]
        if len(gone):
            more = np.concatenate([lists[g] for g in gone])
            keep = np.unique(np.concatenate([keep, more[~dead[more]]]))
            keep = keep[keep != i]
            if len(keep) > degree:
                long.append(i)
        out.append(keep)
    shares = Sharing(labels) if labels is not None else None
    for i, kept in zip(long, prune(np.array(long, np.int64), [out[i] for i in long], x, degree, alpha, metric=metric, labels=shares, saturate=labels is not None)):
        out[i] = kept
    return out


def connect_labels(lists: list[np.ndarray], labels: list[frozenset], x: np.ndarray, metric: str) -> None:
    """Makes the points of each label reachable from its start through points that have it.

    A point that is not gets an edge from the nearest one that is, beyond the degree if need be.
    """
    members = members_of(labels)
    for label, start in label_starts(members, len(lists)).items():
        inside, reached = np.zeros(len(lists), bool), np.zeros(len(lists), bool)
        inside[members[label]] = True
        todo = [start]
        reached[start] = True
        while True:
            while todo:
                new = lists[todo.pop()]
                new = new[inside[new] & ~reached[new]]
                reached[new] = True
                todo.extend(new.tolist())
            lost = np.flatnonzero(inside & ~reached)
            if not len(lost):
                break
            have = np.flatnonzero(reached)
            near = have[pairwise(metric, x[lost[:1]], x[have])[0].argmin()]
            lists[near] = np.append(lists[near], lost[0])
            reached[lost[0]] = True
            todo = [int(lost[0])]


def label_starts(members: dict[int, np.ndarray], n: int, seed: int = 0, pool: int = STARTS) -> dict[int, int]:
    """A start point for each label: of some of its points, the one that the fewest labels before it start from.

    members: the points of each label. Labels take their turn by number; of equals the smallest point.
    """
    rng, used, out = np.random.default_rng(seed), np.zeros(n, np.int64), {}
    for label in sorted(members):
        some = members[label]
        some = np.sort(rng.choice(some, pool, replace=False)) if len(some) > pool else np.sort(some)
        out[label] = int(some[used[some].argmin()])
        used[out[label]] += 1
    return out


def members_of(labels: list) -> dict[int, np.ndarray]:
    """The points of each label, from the labels of each point."""
    out: dict[int, list[int]] = {}
    for i, own in enumerate(labels):
        for v in sorted(set(own or ())):
            out.setdefault(v, []).append(i)
    return {v: np.array(p, np.int64) for v, p in out.items()}
