"""Substring dedup over words by fixed-block anchors.

A repeat of at least 13 words holds a whole block of 7 of the reference document's words, if blocks
are cut every 7 words. So the non-overlapping 7-word blocks of all documents are indexed by hash
and probed with every rolling 7-word window of all documents: a hash that is both, and that at least
two documents have, is an anchor. Windows of 13 words that hold an anchor are the places where an
anchor may extend to a repeat; they are compared whole (a 64-bit hash within a bucket of an
independent hash), which extends hits to maximal exact repeats: a run of repeated windows is one.
A window repeats if its words also start in a document with a smaller id; every word that such a
window covers is removed. Windows are judged on the input.

Blocks and probes travel as sorted 26-bit remainders packed by bucket, about two bytes each; the
answers are lists of anchors and one bit for each window.

Nulls: a null text has no words; a null id counts as the largest. Rows that repeat an id do not
remove each other's words. Texts of fewer than 13 words lose nothing. An empty table gives no rows.
Extra columns are dropped, whatever their names. A chunk holds a bounded number of rows and bytes of
text; a text stays whole, and a task takes some 30 times the bytes of its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mixed, slices, word_hashes, words
from .exchange import binary_rows, bucket_bits, chunked, from_deltas, measured, sliced_rows, to_deltas

WINDOW, BLOCK = 13, 7
_REST = 26
_LAST = np.iinfo(np.int64).max
_K = np.random.default_rng(77).integers(1, 2**63, (3, WINDOW), dtype=np.uint64) | np.uint64(1)
_TABLE = 1 << 24


class Texts:
    """The words of a chunk's texts."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("uid")
        self.ids = table.column("id")
        self.order = np.array(table.column("id").fill_null(_LAST), np.int64)
        self.data, self.offsets = flat(table.column("text"))
        starts, ends, hashes, at = [], [], [], [np.zeros(1, np.int64)]
        for a, b in slices(self.offsets):
            base = self.offsets[a]
            part = self.data[base : self.offsets[b]]
            s, e, w = words(part, self.offsets[a : b + 1] - base)
            starts.append(s + base), ends.append(e + base), hashes.append(word_hashes(part, s, e)), at.append(w[1:] + at[-1][-1])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.starts, self.ends, self.hashes, self.at = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64), np.concatenate(at)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.left = self.at[1:][self.doc] - np.arange(len(self.doc))  # words from here to the text's end

    def grams(self, n: int, k: np.ndarray) -> np.ndarray:
        """Hashes of the n-word windows at all positions but the last n - 1 of the chunk."""
        size = max(0, len(self.hashes) - n + 1)
        h = np.zeros(size, np.uint64)
        for j in range(n):
            h += self.hashes[j : j + size] * k[j]
        return mixed(h)

    def anchors(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket and remainder of each 7-word window, where there is one)"""
        h = self.grams(BLOCK, _K[0]) >> np.uint64(64 - bits - _REST)
        return h, self.left[: len(h)] >= BLOCK


def _packed_anchors(table: pa.Table, bits: int) -> pa.Table:
    """One row a bucket: remainders of the chunk's 7-word windows, and whether it is a block, or in two texts."""
    texts, chunk = Texts(table), table.column("chunk")[0].as_py()
    h, there = texts.anchors(bits)
    at = np.flatnonzero(there)
    doc = texts.doc[at]
    block = (at - texts.at[:-1][doc]) % BLOCK == 0
    value = h[at]
    order = np.argsort(value)
    value, doc, block = value[order], doc[order], block[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    some_block = np.logical_or.reduceat(block, first) if len(first) else np.zeros(0, bool)
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    value = value[first]
    bucket, rest = value >> np.uint64(_REST), (value & np.uint64((1 << _REST) - 1)).astype(np.uint32)
    rows = [(b, chunk, to_deltas(rest[s]), np.packbits(some_block[s]).tobytes(), np.packbits(several[s]).tobytes()) for b, s in sliced_rows(bucket)]
    return binary_rows(rows, ["bucket", "chunk", "rests", "blocks", "several"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])


def _found_anchors(table: pa.Table) -> pa.Table:
    """For each chunk of one bucket, the remainders that are a block somewhere and in two texts at least."""
    seen = np.zeros(1 << _REST, np.uint8)  # the count up to 2; bit 7 is set by a block
    rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "rests", "blocks", "several"))))
    values = [from_deltas(r[2]) for r in rows]
    for v, r in zip(values, rows):
        bits = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8), count=len(v))
        was = seen[v]
        seen[v] = np.minimum(2, (was & 127) + 1 + bits(r[4])) | (was & 128) | (bits(r[3]) << 7)
    found = [(r[1], r[0], to_deltas(v[seen[v] == 130])) for v, r in zip(values, rows)]
    return binary_rows([f for f in found if f[2]], ["chunk", "bucket", "rests"], [pa.int32(), pa.int32(), pa.binary()])


def _windows(texts: Texts, anchors: pa.Table, bits: int, bits2: int):
    """The chunk's candidate windows: (place, key, order by bucket and key, buckets and keys in that order)."""
    table = np.zeros(_TABLE, bool)
    table2 = np.zeros(_TABLE, bool)
    low = np.uint64(_TABLE - 1)
    other = lambda x: ((x * _K[2, 0]) >> np.uint64(40)) & low
    for b, raw in zip(anchors.column("bucket").to_pylist(), anchors.column("rests").to_pylist()):
        v = from_deltas(raw).astype(np.uint64) | (np.uint64(b) << np.uint64(_REST))
        table[(v & low).astype(np.int64)] = True
        table2[other(v).astype(np.int64)] = True
    h, there = texts.anchors(bits)
    hit = np.zeros(len(texts.hashes) + 1, np.int64)  # a false hit costs a comparison, nothing else
    if anchors.num_rows:
        hit[1 : len(h) + 1] = there & table[(h & low).astype(np.int64)] & table2[other(h).astype(np.int64)]
    hit = np.cumsum(hit)
    size = max(0, len(texts.hashes) - WINDOW + 1)
    inner = WINDOW - BLOCK + 1
    place = np.flatnonzero((texts.left[:size] >= WINDOW) & (hit[inner : inner + size] > hit[:size])) if size else np.zeros(0, np.int64)
    key, key2 = texts.grams(WINDOW, _K[0])[place], texts.grams(WINDOW, _K[1])[place]
    bucket = (key2 >> np.uint64(63 - bits2)) >> np.uint64(1)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(bucket[order].astype(np.uint16 if bits2 <= 16 else np.uint32), kind="stable")]
    return place, order, bucket[order], key[order]


def _least(texts: Texts, place, order, bucket, key):
    """Where each distinct (bucket, key) starts in the order, and the smallest id that the chunk has for it."""
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]))
    return first, np.minimum.reduceat(texts.order[texts.doc[place[order]]], first)


def _packed_windows(docs: pa.Table, anchors: pa.Table, bits: int, bits2: int) -> pa.Table:
    """One row a bucket: the chunk's distinct candidate windows and the smallest id of each."""
    names, kinds = ["bucket", "chunk", "keys", "ids", "which"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    if not docs.num_rows or not anchors.num_rows:
        return binary_rows([], names, kinds)
    texts, chunk = Texts(docs), docs.column("chunk")[0].as_py()
    place, order, bucket, key = _windows(texts, anchors, bits, bits2)
    first, least = _least(texts, place, order, bucket, key)
    rows = []
    for b, s in sliced_rows(bucket[first]):
        ids, which = np.unique(least[s], return_inverse=True)
        rows.append((b, chunk, key[first[s]].tobytes(), ids.tobytes(), which.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes()))
    return binary_rows(rows, names, kinds)


def _earlier(table: pa.Table) -> pa.Table:
    """For each chunk of one bucket a bit for each of its windows: another chunk has it with a smaller id."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "keys", "ids", "which"))))
    keys = [np.frombuffer(r[2], np.uint64) for r in rows]
    own = [np.frombuffer(r[3], np.int64)[np.frombuffer(r[4], np.uint16 if len(r[3]) <= 8 << 16 else np.uint32)] for r in rows]
    key, ids = np.concatenate(keys), np.concatenate(own)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    least = np.minimum.reduceat(ids[order], first)
    smaller = np.zeros(len(key), bool)
    smaller[order] = np.repeat(least, np.diff(np.concatenate([first, [len(key)]]))) < ids[order]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    out = [(r[1], r[0], np.packbits(x).tobytes()) for r, x in zip(rows, np.split(smaller, cuts)) if x.any()]
    return binary_rows(out, ["chunk", "bucket", "rests"], [pa.int32(), pa.int32(), pa.binary()])


def _cleaned(docs: pa.Table, answers: pa.Table, bits: int, bits2: int) -> pa.Table:
    names, kinds = ["uid", "id", "n_words", "n_removed", "spans", "kept_text"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
    if not docs.num_rows:
        return binary_rows([], names, kinds)
    docs = docs.combine_chunks().sort_by("uid")
    texts = Texts(docs)
    gone = np.zeros(len(texts.hashes) + 1, np.int64)
    said = answers.filter(answers.column("kind").combine_chunks().to_numpy(zero_copy_only=False) == 1)
    anchors = answers.filter(answers.column("kind").combine_chunks().to_numpy(zero_copy_only=False) == 0)
    if anchors.num_rows:
        place, order, bucket, key = _windows(texts, anchors, bits, bits2)
        first, least = _least(texts, place, order, bucket, key)
        bit = np.zeros(len(first), bool)
        cuts = dict(sliced_rows(bucket[first]))
        for b, raw in zip(said.column("bucket").to_pylist(), said.column("rests").to_pylist()):
            s = cuts[b]
            bit[s] = np.unpackbits(np.frombuffer(raw, np.uint8), count=s.stop - s.start)
        sizes = np.diff(np.concatenate([first, [len(order)]]))
        at = place[order]
        at = at[np.repeat(bit, sizes) | (texts.order[texts.doc[at]] > np.repeat(least, sizes))]
        gone[: len(gone)] += np.bincount(at, minlength=len(gone)) - np.bincount(at + WINDOW, minlength=len(gone))
    removed = (np.cumsum(gone) > 0)[:-1]
    n_removed = np.add.reduceat(np.concatenate([removed, [False]]).astype(np.int64), texts.at[:-1]) * (np.diff(texts.at) > 0)
    # kept words, one space after each
    kept = np.flatnonzero(~removed)
    long = texts.ends[kept] - texts.starts[kept]
    to = np.cumsum(long + 1) - (long + 1)
    buffer = np.full(int((long + 1).sum()), 32, np.uint8)
    solid = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    buffer[solid + np.repeat(to, long)] = texts.data[solid + np.repeat(texts.starts[kept], long)]
    whole = buffer.tobytes()
    ends = np.concatenate([to, [len(whole)]])[np.searchsorted(kept, texts.at)].tolist()
    rows = []
    uids, ids = docs.column("uid").to_pylist(), texts.ids.to_pylist()
    for i, (a, b) in enumerate(zip(texts.at[:-1].tolist(), texts.at[1:].tolist())):
        spans = []
        if n_removed[i]:
            own = np.diff(np.concatenate([[0], removed[a:b].astype(np.int8), [0]]))
            spans = np.column_stack([np.flatnonzero(own == 1), np.flatnonzero(own == -1)]).tolist()
        rows.append((uids[i], ids[i], b - a, int(n_removed[i]), spans, whole[ends[i] : max(ends[i], ends[i + 1] - 1)].decode()))
    return binary_rows(rows, names, kinds)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text) of every row: spans are [start, end) in words."""
    size = measured(docs, text_col)
    bits, bits2 = bucket_bits(size) + 2, bucket_bits(size)
    rows = chunked(docs, size, id_col, text_col)
    probes = rows.groupBy("chunk").applyInArrow(lambda t: _packed_anchors(t, bits), "bucket int, chunk int, rests binary, blocks binary, several binary")
    anchors = probes.groupBy("bucket").applyInArrow(_found_anchors, "chunk int, bucket int, rests binary")
    windows = rows.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(lambda d, a: _packed_windows(d, a, bits, bits2), "bucket int, chunk int, keys binary, ids binary, which binary")
    earlier = windows.groupBy("bucket").applyInArrow(_earlier, "chunk int, bucket int, rests binary")
    answers = anchors.withColumn("kind", F.lit(0)).unionByName(earlier.withColumn("kind", F.lit(1)))
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda d, a: _cleaned(d, a, bits, bits2), "uid bigint, id bigint, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept_text string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", "kept_text")
