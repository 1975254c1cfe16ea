"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole text are computed by numpy over Arrow batches. Trees are grown level by
level on binned features (gradient and hessian histograms), then flattened into three arrays, so
that a batch walks all trees at once: `depth` rounds of gathers, no branch for each row or tree.

Fitting uses at most about `sample_docs` labelled rows, chosen by a hash of the id (a documented
bound); scoring reads every text. Only the flattened arrays travel to the executors.

Nulls: a null text has the statistics of an empty one and gets a score; rows with a null id or null
label are not learned from. A document that several labels name is learned from with each of them.
With labels of one class, or none, every score is that class's share (0.5 for none). Extra columns
are dropped; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, lowered, slices, word_hashes, words

_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r", "stop": b".,;:", "mark": b"!?", "quote": b"'\"()-", "bar": b"|/\\_=+", "sign": b"#$%&*@~^<>[]{}`"}
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _set in enumerate(_CLASSES.values()):
    _CLASS[list(_set)] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2
FEATURES = [*_CLASSES, "control", "high", "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "repeated_word", "line_words", "distinct_lines", "upper_start", "word_end_mark"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)), np.float32)
    for a, b in slices(offsets):
        out[a:b] = _statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, lens = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n) * _N_CLASSES, lens)
    share = np.bincount(row + _CLASS[data], minlength=n * _N_CLASSES).reshape(n, -1) / np.maximum(1, lens)[:, None]
    starts, ends, at = words(data, offsets)
    of = np.repeat(np.arange(n), np.diff(at))
    n_words, size = np.diff(at), ends - starts
    total = np.maximum(1, n_words)
    by_row = lambda x: np.bincount(of, weights=x, minlength=n)
    h = word_hashes(lowered(data), starts, ends)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    keys = np.unique((h & np.uint64(0xFFFFFFFFFFF)) | (of.astype(np.uint64) << np.uint64(44)))
    distinct = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=n)
    # lines: cut at line feeds, judged by the hash of their bytes
    feed = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], feed + 1, offsets[1:]]))
    cuts = cuts[cuts <= len(data)]
    line_a, line_b = cuts[:-1], cuts[1:]
    line_of = np.searchsorted(offsets, line_a, "right") - 1
    lines = np.bincount(line_of, minlength=n) if len(line_a) else np.zeros(n, int)
    lh = word_hashes(data, line_a, line_b)
    lk = np.unique((lh & np.uint64(0xFFFFFFFFFFF)) | (line_of.astype(np.uint64) << np.uint64(44)))
    line_kinds = np.bincount((lk >> np.uint64(44)).astype(np.int64), minlength=n)
    capital = _CLASS[data[starts]] == 1
    tail = _CLASS[data[ends - 1]]
    return np.column_stack([
        share, np.log1p(lens), np.log1p(n_words), by_row(size) / total, by_row(size > 12) / total, distinct / total, by_row(same) / total,
        n_words / np.maximum(1, lines), line_kinds / np.maximum(1, lines), by_row(capital) / total, by_row((tail == 6) | (tail == 9)) / total,
    ])


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node k of tree t has children 2k+1 and 2k+2."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for a in range(0, len(x), block) if len(self.feature) else ():
            part = x[a : a + block]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.limit[trees, node])
            out[a : a + block] += self.leaf[trees, node - (1 << self.depth) + 1].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for log loss on rows x (float32) with labels y (0 or 1)."""
    share = float(np.mean(y)) if len(y) else 0.5
    inner, leaves = (1 << depth) - 1, 1 << depth
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), depth, float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))
    if len(y) == 0 or share in (0.0, 1.0):
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    feature, limit, leaf = [], [], []
    margin = np.full(len(y), empty.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        tree_f, tree_l = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best, choice = np.full(width, 1e-6), [(0, np.inf, bins)] * width
            for f, e in enumerate(edges):
                key = local * bins + binned[:, f]
                gs, hs = (np.bincount(key, weights=v, minlength=width * bins).reshape(width, bins).cumsum(1) for v in (g, h))
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = -1
                gain[:, len(e) :] = -1
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[k], choice[k] = gain[k, at[k]], (f, e[at[k]], at[k])
            cut = np.array([c[2] for c in choice])
            which = np.array([c[0] for c in choice])
            tree_f[first : first + width], tree_l[first : first + width] = which, [c[1] for c in choice]
            node = 2 * node + 1 + (binned[np.arange(len(y)), which[local]] > cut[local])
        local = node - inner
        value = -rate * np.bincount(local, weights=g, minlength=leaves) / (np.bincount(local, weights=h, minlength=leaves) + l2)
        margin += value[local]
        feature.append(tree_f), limit.append(tree_l), leaf.append(value)
    return Trees(np.array(feature), np.array(limit), np.array(leaf), depth, empty.base)


def _with_statistics(docs: DataFrame, id_col: str, text_col: str, more: list[str], made, schema: str) -> DataFrame:
    keep = [id_col, *more]
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made(statistics(*flat(batch.column(batch.num_columns - 1))))], [*names, "made"])

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    return rows.mapInArrow(run, f"{kinds}, made {schema}")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 20_000) -> Trees:
    """Trees fitted to about `sample_docs` labelled documents."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rate = min(1.0, sample_docs / max(1, known.count()))
    luck = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(2)), 11) / float(1 << 53)
    some = known.where(luck <= rate).select(F.col(id_col).alias("its_id"), F.col(label_col).cast("double").alias("its_label"))
    # about sample_docs short rows at most, so a broadcast has a fixed bound
    rows = docs.select(F.col(id_col).alias("its_id"), F.col(text_col).alias("its_text")).join(F.broadcast(some), "its_id")
    made = _with_statistics(rows, "its_label", "its_text", [], lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32())), "array<float>").toArrow()
    y = made.column(0).to_numpy()
    x = np.asarray(made.column(1).combine_chunks().flatten()).reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)), np.float32)
    order = np.lexsort((*x.T, y))  # rows come in no fixed order; sums shall
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, more..., score) of every row: how likely label 1 is."""
    return _with_statistics(docs, id_col, text_col, list(more), lambda x: pa.array(model.score(x)), "double").toDF(id_col, *more, "score")
