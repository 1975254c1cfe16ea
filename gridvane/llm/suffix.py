"""Suffix-array dedup of byte strings by distributed prefix doubling.

Ranking every byte position of a corpus would cost many times its size, so the positions that are
ranked are anchors: the minimisers of all stretches of 96 16-byte hashes. Like strings have like
anchors, so a 400-byte string belongs to the first anchor of its own bytes, and an anchor owns a run
of at most 96 consecutive strings. The text between two anchors is a phrase.

Doubling: an anchor's first rank is its phrase. A round sends pairs of ranks, of an anchor and of
the anchor as many phrases on as the rank spans, to buckets that sort them, give every pair that
occurs twice its place in the order as the new rank, and drop the others. Two rounds reach four
phrases or the threshold, the bytes that all strings of an anchor share.

What is left is settled exactly. Anchors of one rank compare the bytes that all their strings span:
if those occur twice, all strings of the run repeat. Runs that stay open are cut into twelves, and
those that stay open into single strings, each compared in turn with one representative of every
distinct run of the rank. So long copies cost one comparison for each anchor, and only the edges of
repeats are looked at string by string. Single strings are equal if 64-bit hashes of both their
halves are; runs, if their rank and the hash of all bytes they span are.

So doubling is a prefilter that ends short of the threshold: beyond the bytes that an anchor's strings
share, ranks of anchors say nothing about a single string. Ranking every position, as a plain suffix
array does, would take a row of 16 bytes for each byte of text in every round.

Steps are packed exchanges (exchange.py); every step reads the one shuffle of the text.

Nulls: a null text is empty. Texts below 400 bytes lose nothing. Rows that repeat an id count as
separate texts. Removed bytes may split a character, so kept bytes are binary. An empty table gives
no rows. Extra columns are dropped, whatever their names. A chunk holds a bounded number of rows and
bytes of text; a text stays whole, and a task takes some 60 times the bytes of its longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import flat, mixed, powers, prefix_sums, span_hash
from .exchange import binary_rows, bucket_bits, measured, sliced_rows

LENGTH, GRAM, SPREAD, PART = 400, 16, 96, 12
#: All strings of an anchor share the anchors this far behind it.
SHARED = LENGTH + 2 - 2 * SPREAD - GRAM
#: Bytes that a stretch covers, and stretches that are worked on at once, in the cache.
_REACH, _WORK = GRAM + SPREAD - 1, 1 << 16
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)
_SETTLED, _STANDS, _OPEN = 1, 2, 3
_ENTRY = "bucket int, chunk int, keys binary, more binary, multi binary"
_NAMES = ["bucket", "chunk", "keys", "more", "multi"]
_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_ANSWER = "chunk int, step int, bucket int, said binary"


def _minimisers(sums: np.ndarray, a: int, b: int) -> np.ndarray:
    """For each start in [a, b), where the smallest of the next SPREAD hashes of GRAM bytes is, the first of equals."""
    m = b - a + SPREAD - 1
    _, inverse = powers(a + m)
    h = mixed((sums[a + GRAM : a + GRAM + m] - sums[a : a + m]) * inverse[a : a + m])
    h &= ~np.uint64((1 << 20) - 1)
    h |= np.arange(m, dtype=np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        h = np.minimum(h[:-s], h[s:])
    h = np.minimum(h[:-32], h[32:])  # 64 and 32 more make SPREAD
    return (h & np.uint64((1 << 20) - 1)).astype(np.int64) + a


def pair(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return mixed(a * _A + b * _B)


@dataclass
class Entries:
    """What a chunk sends in one step: its items' distinct keys, sorted by bucket."""

    bucket: np.ndarray
    keys: np.ndarray
    more: np.ndarray
    multi: np.ndarray
    of: np.ndarray  # of each item, its entry

    @classmethod
    def of_items(cls, route: np.ndarray, keys: np.ndarray, more: np.ndarray, multi: np.ndarray, bits: int) -> Entries:
        bucket = (route >> np.uint64(63 - bits)) >> np.uint64(1)
        order = np.lexsort((more, keys, bucket))
        b, k, m = bucket[order], keys[order], more[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        first = np.flatnonzero(new)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        counts = np.bincount(of, minlength=len(first))
        return cls(b[first], k[first], m[first], (counts > 1) | (np.bincount(of, weights=multi, minlength=len(first)) > 0), of)

    def rows(self, chunk: int, bits: int) -> pa.Table:
        lean = not self.more.any()
        out = [(b, chunk, self.keys[s].tobytes(), b"" if lean else self.more[s].tobytes(), self.multi[s].tobytes()) for b, s in sliced_rows(self.bucket)]
        return binary_rows(out, _NAMES, _KINDS)

    def heard(self, answers: pa.Table, step: int, kind, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(answer of each item, bucket of each item)"""
        said = np.zeros(len(self.keys), kind)
        cuts = dict(sliced_rows(self.bucket))
        for s, b, raw in zip(*(answers.column(c).to_pylist() for c in ("step", "bucket", "said"))):
            if s == step:
                said[cuts[b]] = np.frombuffer(raw, kind)
        return said[self.of], self.bucket[self.of]


class Chunk:
    """A chunk's texts, their anchors, and the steps taken so far."""

    def __init__(self, docs: pa.Table, bits: int):
        self.docs, self.bits = docs.combine_chunks().sort_by("uid"), bits
        self.data, self.offsets = flat(self.docs.column("text"))
        self.sums = prefix_sums(self.data)
        self._anchors()

    def _anchors(self) -> None:
        """The minimisers of all stretches within a text, and the strings that each of them owns."""
        n = len(self.data)
        best = [_minimisers(self.sums, a, min(a + _WORK, n - _REACH + 1)) for a in range(0, n - _REACH + 1, _WORK)]
        best = np.concatenate(best) if best else np.zeros(0, np.int64)
        ends = self.offsets[1:]
        fits = np.zeros(len(best) + 1, np.int32)  # stretches that end in the text they start in
        lo, hi = self.offsets[:-1], ends - _REACH + 1
        some = hi > lo
        fits[lo[some]] += 1
        fits[hi[some]] -= 1
        new = np.cumsum(fits)[:-1] > 0
        inside = np.flatnonzero(new & np.concatenate([[True], (best[1:] != best[:-1]) | (fits[1:-1] > 0)])) if len(best) else np.zeros(0, np.int64)
        # a minimiser lies in its own text, so no two texts share one
        self.at = best[inside]
        of = np.searchsorted(ends, self.at, "right")
        self.owner_lo = inside
        same = of[1:] == of[:-1]
        last = np.append(inside[1:] - 1, 0)
        closing = np.append(~same, True) if len(of) else np.zeros(0, bool)
        last = np.where(closing, ends[of] - _REACH, last[: len(of)]) if len(of) else inside
        self.owner_hi = np.minimum(last, ends[of] - LENGTH)
        self.next = np.where(closing, -1, np.arange(1, len(of) + 1))

    def _hop(self, i: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            i = np.where(i >= 0, self.next[i], -1)
        return i

    def round1(self) -> tuple[np.ndarray, Entries]:
        """Pairs of phrases of all anchors that another one follows."""
        who = np.flatnonzero(self.next >= 0)
        phrase = np.zeros(len(self.at), np.uint64)
        phrase[who] = span_hash(self.sums, self.at[who], self.at[self.next[who]])
        two = self._hop(who, 2)
        both = (two >= 0) & (self.at[two] - self.at[who] <= SHARED)
        key = np.where(both, pair(phrase[who], phrase[np.where(both, self.next[who], 0)]), pair(phrase[who], np.uint64(0)))
        return who, self._entries(key)

    def _entries(self, key: np.ndarray, more: np.ndarray | None = None, multi: np.ndarray | None = None) -> Entries:
        zero = np.zeros(len(key), np.uint64)
        return Entries.of_items(mixed(key + _A), key, zero if more is None else more, np.zeros(len(key), bool) if multi is None else multi, self.bits)

    def round2(self, answers: pa.Table) -> tuple[np.ndarray, Entries]:
        """Pairs of ranks of the anchors that own strings and whose first pair was not alone."""
        who, sent = self.round1()
        said, bucket = sent.heard(answers, 1, np.uint32, self.bits)
        rank = np.zeros(len(self.at) + 1, np.uint64)
        rank[who] = np.where(said > 0, (bucket << np.uint64(32)) | said, 0)
        who = np.flatnonzero((rank[:-1] > 0) & (self.owner_hi >= self.owner_lo))
        two, four = self._hop(who, 2), self._hop(who, 4)
        both = (four >= 0) & (self.at[four] - self.at[who] <= SHARED)
        who, two, both = (x[~both | (rank[two] > 0)] for x in (who, two, both))
        return who, self._entries(np.where(both, pair(rank[who], rank[two]), pair(rank[who], np.uint64(0))))

    def runs(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Entries]:
        """(anchor, rank, first string, last string) of the anchors left, by the bytes their strings span."""
        who, sent = self.round2(answers)
        said, bucket = sent.heard(answers, 2, np.uint32, self.bits)
        rank = (bucket << np.uint64(32)) | said
        who, rank = who[said > 0], rank[said > 0]
        lo, hi = self.owner_lo[who], self.owner_hi[who]
        return self.at[who], rank, lo, hi, self._entries(rank, span_hash(self.sums, lo, hi + LENGTH))

    def twelves(self, answers: pa.Table):
        at, rank, lo, hi, sent = self.runs(answers)
        code, _ = sent.heard(answers, 3, np.uint8, self.bits)
        done = [(lo[code < _OPEN], hi[code < _OPEN])]
        go = code > _SETTLED
        at, rank, lo, hi, multi = at[go], rank[go], lo[go], hi[go], code[go] == _STANDS
        first, last = (at - hi) // PART, (at - lo) // PART  # parts count back from the anchor
        n = last - first + 1
        i = np.repeat(np.arange(len(at)), n)
        m = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
        lo, hi = np.maximum(lo[i], at[i] - PART * m - PART + 1), np.minimum(hi[i], at[i] - PART * m)
        group = pair(rank[i], m.astype(np.uint64) + np.uint64(1))
        return done, group, lo, hi, multi[i], self._entries(group, span_hash(self.sums, lo, hi + LENGTH), multi[i])

    def singles(self, answers: pa.Table):
        done, group, lo, hi, multi, sent = self.twelves(answers)
        code, _ = sent.heard(answers, 4, np.uint8, self.bits)
        own = ~multi & (code < _OPEN)
        done.append((lo[own], hi[own]))
        go = code > _SETTLED
        lo, hi, multi = lo[go], hi[go], code[go] == _STANDS
        n = hi - lo + 1
        i = np.repeat(np.arange(len(lo)), n)
        p = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
        half = p + LENGTH // 2
        first, second = span_hash(self.sums, p, half), span_hash(self.sums, half, p + LENGTH)
        return done, p, Entries.of_items(pair(first, second), first, second, multi[i], self.bits)  # dealt by both, as one half may be common

    def removed(self, answers: pa.Table) -> np.ndarray:
        """For each byte, whether a repeated string covers it."""
        done, p, sent = self.singles(answers)
        again, _ = sent.heard(answers, 5, np.uint8, self.bits)
        done.append((p[again > 0], p[again > 0]))
        edge = np.zeros(len(self.data) + 1, np.int64)
        for lo, hi in done:
            edge += np.bincount(lo, minlength=len(edge)) - np.bincount(hi + LENGTH, minlength=len(edge))
        return (np.cumsum(edge) > 0)[:-1]


def _columns(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows' (bucket, chunk), key, second key, whether it stands for several, row) of one bucket's entries."""
    # in order of chunks: a bucket that is worked out again, in any order of arrival, answers alike
    rows = sorted(zip(*(table.column(c).to_pylist() for c in _NAMES)), key=lambda r: r[1])
    keys = [np.frombuffer(r[2], np.uint64) for r in rows]
    more = [np.frombuffer(r[3], np.uint64) if r[3] else np.zeros(len(k), np.uint64) for r, k in zip(rows, keys)]
    multi = np.concatenate([np.frombuffer(r[4], bool) for r in rows])
    return rows, np.concatenate(keys), np.concatenate(more), multi, np.repeat(np.arange(len(rows)), [len(k) for k in keys])


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that sorts the keys, first ones first; for each item in that order, the number of its group)"""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def _answers(rows: list, said: np.ndarray, row: np.ndarray, step: int) -> pa.Table:
    cuts = np.searchsorted(row, np.arange(len(rows) + 1))
    out = [(r[1], step, r[0], said[a:b].tobytes()) for r, a, b in zip(rows, cuts, cuts[1:]) if said[a:b].any()]
    return binary_rows(out, ["chunk", "step", "bucket", "said"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])


def _ranks(table: pa.Table, step: int) -> pa.Table:
    """New ranks of one bucket's pairs: the place in sorted order, 0 for a pair that occurs once."""
    rows, key, _, multi, row = _columns(table)
    order, group = _grouped(key)
    total = np.bincount(group, weights=1 + multi[order])
    said = np.zeros(len(key), np.uint32)
    said[order] = np.where(total[group] > 1, group + 1, 0)
    return _answers(rows, said, row, step)


def _settled(table: pa.Table, step: int) -> pa.Table:
    """Runs that occur twice are settled; one of each stands for it where its group has open runs."""
    rows, key, more, multi, row = _columns(table)
    order, run = _grouped(key, more)
    total = np.bincount(run, weights=1 + multi[order])
    first = np.ones(len(order), bool)
    first[1:] = run[1:] != run[:-1]
    group = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]]))
    has_open = np.bincount(group, weights=total[run] == 1) > 0
    said = np.zeros(len(key), np.uint8)
    said[order] = np.where(total[run] == 1, _OPEN, np.where(first & has_open[group], _STANDS, _SETTLED))
    return _answers(rows, said, row, step)


def _again(table: pa.Table, step: int) -> pa.Table:
    rows, key, more, multi, row = _columns(table)
    order, group = _grouped(key, more)
    said = np.zeros(len(key), np.uint8)
    said[order] = np.bincount(group, weights=1 + multi[order])[group] > 1
    return _answers(rows, said, row, step)


def _cleaned(docs: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    names, kinds = ["id", "n_bytes", "n_removed", "spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    if not docs.num_rows:
        return binary_rows([], names, kinds)
    c = Chunk(docs, bits)
    gone = c.removed(answers)
    whole = c.data[~gone].tobytes()
    ends = np.concatenate([[0], np.cumsum(~gone)])[c.offsets].tolist()
    rows = []
    for i, (doc, a, b) in enumerate(zip(c.docs.column("id").to_pylist(), c.offsets[:-1].tolist(), c.offsets[1:].tolist())):
        kept, spans = whole[ends[i] : ends[i + 1]], []
        if len(kept) < b - a:
            change = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
            spans = np.column_stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)]).tolist()
        rows.append((doc, b - a, b - a - len(kept), spans, kept))
    return binary_rows(rows, names, kinds)


def _functions(number: int, entries, judge, bits: int):
    """What a step does with a chunk, with a chunk and the answers so far, and with a bucket."""

    def both(docs: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not docs.num_rows:
            return binary_rows([], _NAMES, _KINDS)
        return entries(Chunk(docs, bits), answers).rows(docs.column("chunk")[0].as_py(), bits)

    def alone(docs: pa.Table) -> pa.Table:
        return both(docs, None)

    def answer(table: pa.Table) -> pa.Table:
        return judge(table, number)

    return alone, both, answer


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of every row: spans are [start, end) in bytes of UTF-8."""
    size = measured(docs, text_col)
    bits = bucket_bits(size)
    rows = exchange.chunked(docs, size, id_col, text_col)
    steps = [
        (lambda c, a: c.round1()[-1], _ranks),
        (lambda c, a: c.round2(a)[-1], _ranks),
        (lambda c, a: c.runs(a)[-1], _settled),
        (lambda c, a: c.twelves(a)[-1], _settled),
        (lambda c, a: c.singles(a)[-1], _again),
    ]
    answers = None
    for number, (entries, judge) in enumerate(steps, 1):
        alone, both, answer = _functions(number, entries, judge, bits)
        if answers is None:
            sent = rows.groupBy("chunk").applyInArrow(alone, _ENTRY)
        else:
            sent = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, _ENTRY)
        said = sent.groupBy("bucket").applyInArrow(answer, _ANSWER)
        answers = said if answers is None else answers.unionByName(said)
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda d, a: _cleaned(d, a, bits), "id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
