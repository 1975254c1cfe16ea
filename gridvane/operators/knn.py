"""Exact nearest neighbours: plain, filtered, by label, in range, reranked and merged.

A stated set of queries is compared with all base rows in blocks: a block of queries is a small
matrix that every task gets, base rows stream past as Arrow batches, and each batch leaves at most k
rows for each query. A window over (query, distance, id) then ranks; Spark cuts it to k before the
exchange as well. Distances accumulate component by component in double, in the order of
functions.vectors, so both give the same bits.

Where all k nearest of squared L2, of L2 without the query's norm or of inner products are asked for, products in
single precision say which pairs need that distance, and a task leaves k rows a query.

nearest_others() has every row as a query. Rows are dealt into groups and pairs of groups are compared
in tasks of bounded size; matrix products in single precision, with their error bound, say which pairs
need the distance above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_metric
from ..plans.tables import written

#: Nearest of a block of queries, of all together, that a task keeps sorted.
NEAREST = 1 << 23
#: Queries that one pass over the base answers; more queries take more passes, not more memory.
QUERY_BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(metric: str, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """(queries, base) distances, summed component by component."""
    out = np.zeros((len(queries), len(base)))
    if metric == "l2":
        for d in range(base.shape[1]):
            t = base[None, :, d] - queries[:, d, None]
            out += t * t
        return out
    for d in range(base.shape[1]):
        out += base[None, :, d] * queries[:, d, None]
    if metric == "ip":
        return -out
    squares = np.zeros(len(base))
    for d in range(base.shape[1]):
        squares += base[:, d] * base[:, d]
    if metric == "fast_l2":
        return squares[None, :] - 2 * out
    own = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        own += queries[:, d] * queries[:, d]
    norms = np.sqrt(squares)[None, :] * np.sqrt(own)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, np.nan, 1 - out / norms)


def _blocks(queries: DataFrame, names: list[str]) -> Iterator[dict[str, list]]:
    rows: dict[str, list] = {n: [] for n in names}
    for r in queries.select(*names).toLocalIterator():
        for n in names:
            rows[n].append(r[n])
        if len(rows[names[0]]) == QUERY_BLOCK:
            yield rows
            rows = {n: [] for n in names}
    if rows[names[0]]:
        yield rows


def ranked(pairs: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k nearest of each query, (distance, id) ascending, with rank from 1."""
    order = Window.partitionBy(by).orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _candidates(base: DataFrame, queries: DataFrame, metric: str, k: int | None, within: float | None, label: bool, universal: int | str | None = None) -> DataFrame:
    check_metric(metric)
    names = ["query_id", "vec", *(["label"] if label else [])]
    schema = "query_id bigint, id bigint, distance double"
    out = None
    for block in _blocks(queries, names):
        ids = np.array(block["query_id"], np.int64)
        matrix = np.array([np.asarray(v, np.float64) for v in block["vec"]])
        wanted = block.get("label")
        scan = _screener(ids, matrix, wanted, metric, k, universal) if k is not None and k * len(ids) <= NEAREST and metric != "cosine" else _scanner(ids, matrix, wanted, metric, k, within, universal)
        part = base.select(*(["id", "vec", "labels"] if label else ["id", "vec"])).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else base.sparkSession.createDataFrame([], schema)


def _scanner(ids: np.ndarray, matrix: np.ndarray, wanted: list | None, metric: str, k: int | None, within: float | None, universal: int | str | None = None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own, vec = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))
                fits = None
                if wanted is not None:
                    sets = [set(x or ()) for x in part.column(2).to_pylist()]
                    every = np.array([universal is not None and universal in s for s in sets])
                    kinds = {w: every | np.array([w in s for s in sets]) for w in set(wanted)}
                for a in range(0, len(ids), 256):
                    d = distances(metric, matrix[a : a + 256], vec)
                    if wanted is not None:
                        fits = np.array([kinds[w] for w in wanted[a : a + 256]])
                        d = np.where(fits, d, np.inf)
                    if within is not None:
                        i, j = np.nonzero(d <= within)
                    elif k < d.shape[1]:
                        # all that tie with the k-th stay, so ids can decide
                        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                        i, j = np.nonzero(~(d > limit) & (d < np.inf) | np.isnan(d))
                    else:
                        i, j = np.nonzero(~(d == np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 256][i]), pa.array(own[j]), pa.array(d[i, j])], ["query_id", "id", "distance"])

    return scan


def _screener(ids: np.ndarray, matrix: np.ndarray, wanted: list | None, metric: str, k: int, universal: int | str | None = None):
    """As _scanner for the k nearest of all rows of a task, by products in single precision with their error bound, see _meet."""
    with np.errstate(over="ignore", invalid="ignore"):
        q2 = (matrix * matrix).sum(1)
    # the products give what the distance is but for what a query adds to all of its own
    left = np.concatenate([(-1 if metric == "ip" else -2) * matrix, np.ones((len(ids), 1))], 1) if q2.max(initial=0) < 1e30 else None
    left = left.astype(np.float32) if left is not None else None
    norms, add = np.sqrt(q2), q2 if metric == "l2" else np.zeros(len(ids))
    names = list(dict.fromkeys(wanted or []))
    number = {w: n for n, w in enumerate(names)}
    kinds = np.array([number[w] for w in wanted], np.int64) if wanted is not None else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE[1]):
                part = batch.slice(at, PIECE[1])
                own, vec = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))
                fits = None
                if wanted is not None:
                    sets = [set(x or ()) for x in part.column(2).to_pylist()]
                    every = np.array([universal is not None and universal in s for s in sets])
                    fits = np.array([every | np.array([w in s for s in sets]) for w in names])
                with np.errstate(over="ignore", invalid="ignore"):
                    b2 = (vec * vec).sum(1)
                plain = left is None or not b2.max(initial=0) < 1e30  # NaN too
                if not plain:
                    right = np.concatenate([vec, b2[:, None] if metric != "ip" else np.zeros((len(vec), 1))], 1).astype(np.float32).T
                    unit, longest = (vec.shape[1] + 16) * 2.0**-24, np.sqrt(b2.max(initial=0))
                for a in range(0, len(ids), PIECE[0]):
                    q = slice(a, min(a + PIECE[0], len(ids)))
                    if plain:
                        rough, slack, more = distances(metric, matrix[q], vec), np.zeros(q.stop - a), np.zeros(q.stop - a)
                    else:
                        rough, slack, more = left[q] @ right, unit * (norms[q] + longest) ** 2 + 1e-37, add[q]
                    if fits is not None:
                        rough[~fits[kinds[q]]] = np.inf
                    worst = best.d[q, -1] - more
                    limit = np.where(np.isnan(worst), np.inf, worst)
                    if np.isinf(limit).any() and k < rough.shape[1]:
                        first = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
                        limit = np.fmin(limit, np.where(np.isnan(first), np.inf, first))
                    limit = np.nextafter((limit + slack).astype(rough.dtype), np.array(np.inf, rough.dtype))
                    i, j = np.divmod(np.flatnonzero(~(rough > limit[:, None]) & (rough != np.inf)), rough.shape[1])
                    for u in range(0, len(i), 1 << 14):
                        x, y = i[u : u + (1 << 14)], j[u : u + (1 << 14)]
                        d = paired(metric, matrix[q][x], vec[y])
                        x, y, d = (z[d != np.inf] for z in (x, y, d))
                        if len(d):
                            best.add(x + a, d, own[y])
        who, found, d = best.rows(ids)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(found), pa.array(d)], ["query_id", "id", "distance"])

    return scan


def paired(metric: str, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Distances of rows queries[i] and base[i], summed component by component as in distances()."""
    if metric == "l2":
        return _pairwise(queries, base)
    total = lambda t: np.cumsum(t, axis=1)[:, -1] + 0.0 if t.shape[1] else np.zeros(len(t))  # noqa: E731  no -0.0, as sums begin with 0
    dots = total(base * queries)
    if metric == "ip":
        return -dots
    squares = total(base * base)
    if metric == "fast_l2":
        return squares - 2 * dots
    norms = np.sqrt(squares) * np.sqrt(total(queries * queries))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, np.nan, 1 - dots / norms)


def exact(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest base(id, vec) rows of each queries(query_id, vec) row."""
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked(_candidates(base, queries, metric, k, None, False), k).select("query_id", "rank", "id", "distance")


def exact_with_label(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", universal: int | None = None) -> DataFrame:
    """As exact(), among base rows whose labels hold the query's label, or the universal one."""
    return ranked(_candidates(base, queries, metric, k, None, True, universal), k).select("query_id", "rank", "id", "distance")


def filtered(base: DataFrame, label: int, universal: int | None = None) -> DataFrame:
    """Base rows that carry a label, or the universal label; the filter reaches the scan."""
    keep = F.array_contains("labels", label)
    return base.where(keep | F.array_contains("labels", universal) if universal is not None else keep)


#: Rows of a group at most, of both sides of one matrix product, and of a group from which more groups are not made for the sake of more tasks.
GROUP_ROWS, PIECE, SMALL_GROUP = 65536, (512, 2048), 2048
#: Groups that are made for the sake of more tasks, at most; two of them meet in each task.
GROUPS = 12
#: Rows of a table from which groups meet themselves first; below, what that saves is less than a round of tasks takes.
OWN_FIRST = 49152


class _Nearest:
    """The k nearest seen so far of each row of one side, by (distance, id); NaN comes last.

    known: (distances, ids) of the worst of k that each row has elsewhere; NaN where it has not.
    """

    def __init__(self, n: int, k: int, known: tuple[np.ndarray, np.ndarray] | None = None):
        self.k, self.d, self.id, self.known = k, np.full((n, k), np.nan), np.full((n, k), np.iinfo(np.int64).max), known

    def limit(self, part: slice, least_id: int) -> np.ndarray:
        """Distances up to which a row with an id from least_id on can still enter; a row full of copies with smaller ids takes none."""
        worst, last = self.d[part, -1], self.id[part, -1]
        if self.known is not None:
            d, of = self.known[0][part], self.known[1][part]
            nearer = (d < worst) | (d == worst) & (of < last) | np.isnan(worst)
            worst, last = np.where(nearer, d, worst), np.where(nearer, of, last)
        return np.where((worst == 0) & (last < least_id), -np.inf, np.where(np.isnan(worst), np.inf, worst))

    def add(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        own, count = rows[start], np.diff(np.append(start, len(rows)))
        # a line for each row: its k so far, then what is new
        line, place = np.repeat(np.arange(len(own)), count), self.k + np.arange(len(rows)) - np.repeat(start, count)
        shape = (len(own), self.k + count.max())
        all_d, all_id = np.full(shape, np.nan), np.full(shape, np.iinfo(np.int64).max)
        all_d[:, : self.k], all_id[:, : self.k] = self.d[own], self.id[own]
        all_d[line, place], all_id[line, place] = d[order], ids[order]
        best = np.lexsort((all_id, all_d))[:, : self.k]
        self.d[own], self.id[own] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_id, best, 1)

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.id < np.iinfo(np.int64).max
        return np.repeat(ids, got.sum(1)), self.id[got], self.d[got]


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows a[i] and b[i], summed component by component."""
    if not a.shape[1]:
        return np.zeros(len(a))
    t = b - a
    t *= t
    return np.cumsum(t, axis=1)[:, -1]


def _set(mask: np.ndarray) -> np.ndarray:
    """Places that are set in a mask of few: eight are looked at together."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    row, col = np.nonzero(flat.reshape(-1, 8)[some])
    return some[row] * 8 + col


def _meet(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, same: bool, known: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, distances): the k nearest in b of each row of a and, but for a group with itself, the other way round.

    known: of both sides, what _Nearest knows from elsewhere; what is farther than that may be left out.
    """
    near, back = _Nearest(len(a), k, known and known[0]), None if same else _Nearest(len(b), k, known and known[1])
    with np.errstate(over="ignore", invalid="ignore"):
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
    plain = not (a2.max(initial=0) < 1e30 and b2.max(initial=0) < 1e30)  # NaN too
    if not plain:
        a_norm, b_norm = np.sqrt(a2), np.sqrt(b2)
        left = np.concatenate([-2 * a, np.ones((len(a), 1)), a2[:, None]], 1).astype(np.float32)
        right = np.ascontiguousarray(np.concatenate([b, b2[:, None], np.ones((len(b), 1))], 1).astype(np.float32).T)
        unit = (a.shape[1] + 16) * 2.0**-24  # a sum of products is off by no more than this times (norm + norm) squared, inputs rounded
        products = np.empty(PIECE[0] * PIECE[1], np.float32)
    within = np.empty(PIECE[0] * PIECE[1], bool)  # these are filled anew by every two pieces: fresh memory for each would cost as much as the product
    for i in range(0, len(a), PIECE[0]):
        p = slice(i, min(i + PIECE[0], len(a)))
        for j in range(0, len(b), PIECE[1]):
            q = slice(j, min(j + PIECE[1], len(b)))
            shape = (p.stop - i, q.stop - j)
            size = shape[0] * shape[1]
            if plain:
                rough = distances("l2", a[p], b[q])
                rough[np.isnan(rough)] = np.inf
                slack = slack_back = 0.0
            else:
                rough = np.matmul(left[p], right[:, q], out=products[:size].reshape(shape))
                slack = unit * (a_norm[p] + b_norm[q].max()) ** 2 + 1e-37
                slack_back = unit * (b_norm[q] + a_norm[p].max()) ** 2 + 1e-37
            for seen, axis, part, extra, least in ((near, 1, p, slack, b_ids[j]), (back, 0, q, slack_back, a_ids[i])):
                if seen is None:
                    continue
                limit = seen.limit(part, least)
                if np.isinf(limit).any() and k + 1 < rough.shape[axis]:  # the first rows that these meet; one of them may be the row itself
                    limit = np.minimum(limit, np.partition(rough, k, axis=axis).take(k, axis=axis) + extra)
                limit = np.nextafter((limit + extra).astype(rough.dtype), np.array(np.inf, rough.dtype))
                x, y = np.divmod(_set(np.less_equal(rough, limit[:, None] if axis else limit, out=within[:size].reshape(shape))), shape[1])
                x, y = x + i, y + j
                other = a_ids[x] != b_ids[y]
                x, y = x[other], y[other]
                for at in range(0, len(x), 1 << 12):
                    u, v = x[at : at + (1 << 12)], y[at : at + (1 << 12)]
                    d = _pairwise(a[u], b[v])
                    u, v, d = (z[d != np.inf] for z in (u, v, d))
                    if len(d):
                        seen.add(*((u, d, b_ids[v]) if axis else (v, d, a_ids[u])))
    yield near.rows(a_ids)
    if back is not None:
        yield back.rows(b_ids)


def nearest_others(base: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest other rows of every row of base(id, vec), by squared L2; distances and ties as in exact().

    All pairs are compared, so time grows with the square of the rows. A task compares two groups of at
    most some GROUP_ROWS rows, whatever the table's size; it gets no more than those rows and gives k for each.
    In a larger table each group meets itself first: rows go to the other groups with the k-th distance of their
    own, so that less of what these hold has to be measured and sorted in.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    n = base.count()
    groups = max(-(-n // GROUP_ROWS), min(GROUPS, -(-n // SMALL_GROUP)), 1)
    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("own")
    if groups == 1 or n < OWN_FIRST:
        return ranked(_met(base.select("id", "vec", own), groups, k), k).select("query_id", "rank", "id", "distance")
    first = written(_compared(base.select(own.alias("cell"), F.lit(False).alias("second"), F.lit(True).alias("same"), "id", "vec"), groups, k))
    worst = first.groupBy("query_id").agg(F.max(F.struct("distance", "id")).alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    worst = worst.select(F.col("query_id").alias("id"), F.col("worst.distance").alias("known"), F.col("worst.id").alias("known_id"))
    rest = _met(base.select("id", "vec", own).join(worst, "id", "left"), groups, k, own_too=False)
    return ranked(first.unionByName(rest), k).select("query_id", "rank", "id", "distance")


def _met(x: DataFrame, groups: int, k: int, own_too: bool = True) -> DataFrame:
    """(query_id, id, distance): what each pair of groups of x(id, vec, own[, known, known_id]) leaves; own_too: each group with itself as well."""
    known = [c for c in ("known", "known_id") if c in x.columns]
    x = x.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    x = x if own_too else x.where("own <> met")
    low, high, last = F.least("own", "met"), F.greatest("own", "met"), groups if own_too else groups - 1
    cell = low * last - (low * (low - 1) / 2).cast("int") + high - low - (0 if own_too else 1)
    x = x.select(cell.alias("cell"), (F.col("own") > F.col("met")).alias("second"), (low == high).alias("same"), "id", "vec", *known)
    return _compared(x, last * (last + 1) // 2, k)


def _compared(x: DataFrame, cells: int, k: int) -> DataFrame:
    """(query_id, id, distance) of x(cell, second, same, id, vec[, known, known_id]), a task for each cell."""
    x = x.repartitionById(cells, F.col("cell"))  # by a hash some tasks get several, and others none

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, second = table.column("id").to_numpy(), table.column("second").to_numpy()
        vec = table.column("vec").combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        if vec.null_count or vec.flatten().null_count:
            raise ValueError("a vector or a component is null")
        matrix = _matrix(vec)
        order = np.argsort(ids, kind="stable")
        a, b = order[~second[order]], order[second[order]]
        same = table.column("same")[0].as_py()
        b = a if same else b
        more = ()
        if "known" in table.column_names:
            d, of = table.column("known").fill_null(np.nan).to_numpy(), table.column("known_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            more = (((d[a], of[a]), (d[b], of[b])),)
        found = list(_meet(ids[a], matrix[a], ids[b], matrix[b], k, same, *more)) if len(a) and len(b) else []
        parts = [np.concatenate([f[c] for f in found]) if found else [] for c in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(parts, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "distance"])

    return x.groupBy("cell").applyInArrow(compare, "query_id bigint, id bigint, distance double")


def in_range(base: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """(query_id, id, distance) of all base rows at distance <= radius."""
    return _candidates(base, queries, metric, None, radius, False)


def without_tombstones(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Base rows whose id is not in tombstones(id)."""
    return base.join(tombstones.select("id"), "id", "left_anti")


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, distance: Column, factor: int = 3) -> DataFrame:
    """Keeps the best factor * k candidates(query_id, id, distance), measures them anew on full vectors, keeps k.

    distance: an expression over vec (of the base) and query_vec.
    """
    first = ranked(candidates, factor * k).select("query_id", "id")
    full = first.join(base.select("id", "vec"), "id").join(queries.select("query_id", F.col("vec").alias("query_vec")), "query_id")
    return ranked(full.select("query_id", "id", distance.alias("distance")), k).select("query_id", "rank", "id", "distance")


def merge_results(results: list[DataFrame], k: int) -> DataFrame:
    """One ranked list from results(query_id, rank, id, distance) of several indexes; ties go to the first index."""
    union = None
    for part, r in enumerate(results):
        r = r.withColumn("partition", F.lit(part).cast("bigint"))
        union = r if union is None else union.unionByName(r)
    order = Window.partitionBy("query_id").orderBy("distance", "partition", "rank")
    out = union.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)
    return out.select("query_id", F.col("place").alias("rank"), "id", "distance", "partition")


def real_ids(results: DataFrame, dummies: DataFrame) -> DataFrame:
    """results with dummy ids replaced by those of dummies(dummy_id, real_id)."""
    x = results.join(dummies, results["id"] == dummies["dummy_id"], "left")
    return x.withColumn("id", F.coalesce("real_id", "id")).drop("dummy_id", "real_id")


def cut_truth(truth: DataFrame, radius: float) -> DataFrame:
    """The rows of a truth table within a range."""
    return truth.where(F.col("distance") <= radius)
