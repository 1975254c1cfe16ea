"""LM scoring by online logistic context mixing.

A text is its lower-cased words with one space between them and an end mark. Every byte is eight
binary decisions. Three predictors give counts of zeros and ones for a decision: after the last two
and three bytes of the word, and after the whole word so far. In its first bytes the first two
contexts also hold the last byte above 0x7F that the text had before the word (what tells languages
apart), the first one, anywhere, what ended the word before, if that is neither a letter or digit nor a full stop or comma. Each prediction is stretched to the
logistic domain and weighted by a weight that gates choose, from how often this context and that of
the word so far were seen and whether they were ever mixed. The sum is squashed to a probability,
which an adaptive map of (place within the byte, probability) refines by what was seen after such a
prediction. The bits of a text add up to its log probability.

Counts are exact and grow with the corpus. A context is a hash of 56 bits and has counts of the bytes
that followed it; the counts of a decision are sums over the bytes that agree so far. Chunks of texts
send their distinct (context, byte) pairs to buckets of the hash space, which answer with all bytes
that followed each context in the training texts (exchange.py). No task holds a table of the corpus.

Weights and the map are learned online in each chunk, by mini-batches over all its training decisions:
each is predicted from the chunk's counts without the occurrence itself, and the errors correct the
weights batch after batch. Chunks' maps are summed and their weights averaged by how often each was
used, in a tree of sums; these have a fixed size. Scoring applies them to the counts of the whole
corpus and does not adapt any further.

Equal decisions in a chunk (same contexts, same byte) are worked out once.

The baseline scores tokens by their smoothed counts over all training texts, which are the counts of
what ends a word after the whole word.

Nulls: a null text is empty and has one token, the end. Rows with a null id are learned from.
Without training texts every bit has probability one half and every token 1 / 1. Repeated rows are
learned from and scored each; ties do not occur. An empty table gives no rows. Extra columns are
dropped, whatever their names. A chunk holds a bounded number of rows and bytes of text; a text stays
whole, and a task takes some 100 times the bytes of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, flat, lowered, mixed, powers, prefix_sums, span_hash, words
from .exchange import binary_rows, bucket_bits, chunked, measured, sliced_rows

END, SPACE = 10, 32
#: Predictors, and the one whose gate chooses a set of weights: that of the word so far.
PREDICTORS, LEADS = 3, 2
GATES, SEEN = 26, 13
KNOTS, REACH = 33, 12.0
#: Decisions between two corrections of the weights, in bytes.
BATCH = 1 << 10
#: Bytes at the start of a word that are told apart by the last high byte before it.
NEAR = 4
#: Rows that one step of the tree of sums adds.
FAN_IN = 256
_K = np.random.default_rng(909).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFF)
#: Leading bits that two bytes share, by their exclusive or.
_SHARED = np.array([8 - int(i).bit_length() for i in range(256)], np.int64)
_PLACE = np.arange(8)
#: Of each byte's eight bits: the place in the tree of bits times KNOTS, and the bit.
_NODE = ((1 << _PLACE) | (np.arange(256)[:, None] >> (8 - _PLACE))) * KNOTS
_ONE = (np.arange(256)[:, None] >> (7 - _PLACE)) & 1 == 1
#: What ends a word, if it is no letter, digit, full stop or comma.
_MARK = np.array([0 if i > 127 or chr(i).isalnum() or chr(i) in ".," else i for i in range(256)], np.uint8)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct key occurs first, of each key the number of its distinct one).

    One sort of the keys' upper bits with the place in the lower ones; should two keys share their
    upper bits, the plain way is taken.
    """
    shift = np.uint64(max(1, int(len(key)).bit_length()))
    low = (np.uint64(1) << shift) - np.uint64(1)
    x = np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64))
    place = (x & low).astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] ^ x[:-1]) > low
    of = np.empty(len(x), np.int64)
    of[place] = np.cumsum(new) - 1
    first, full = place[new], key[place]
    if ((full[1:] != full[:-1]) & ~new[1:]).any():
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return first, of


def _context(kind: int, value: np.ndarray) -> np.ndarray:
    """56 bits in the upper bytes, the lowest two of them the predictor; the last byte is for what follows."""
    return (mixed(value + _K[kind]) & ~np.uint64(0x3FF)) | np.uint64(kind << 8)


_NO_WORD = _context(LEADS, span_hash(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)))[0]


@dataclass
class Events:
    """Distinct (word so far, last high byte, next byte) decisions of some texts."""

    pairs: list[np.ndarray]  # per predictor, each decision's context and byte
    byte: np.ndarray
    step: np.ndarray  # of each byte of the distinct tokens in turn, its decision
    begin: np.ndarray  # where each distinct token begins in `step`
    token: np.ndarray  # of each word of the texts in turn, its distinct token
    at: np.ndarray  # where each text's words begin in `token`
    size: np.ndarray  # bytes of each text that are scored

    @classmethod
    def of_texts(cls, data: np.ndarray, offsets: np.ndarray) -> Events:
        low = lowered(data)
        starts, ends, at = words(low, offsets)
        none = np.flatnonzero(np.diff(at) == 0)  # a text without words has an empty one
        starts, ends = np.insert(starts, at[none], offsets[none]), np.insert(ends, at[none], offsets[none])
        per = np.maximum(1, np.diff(at))
        at = np.concatenate([[0], np.cumsum(per)])
        final = np.zeros(len(starts), bool)
        final[at[1:] - 1] = True
        high = np.flatnonzero(low > 127)
        high = np.concatenate([[-1], high])[np.searchsorted(high, starts)]
        low = np.append(low, np.uint8(0))
        high = np.where(high >= np.repeat(offsets[:-1], per), low[high], 0).astype(np.uint64)
        first = np.zeros(len(starts), bool)
        first[at[:-1]] = True
        before = np.concatenate([[0], ends[:-1]])
        high |= np.where(first, 0, _MARK[low[before - 1]]).astype(np.uint64) << np.uint64(8)
        sums = prefix_sums(low[:-1])
        first, token = _distinct(mixed(span_hash(sums, starts, ends) + high * _K[8]) + final * _K[9])
        s, size, high, final = starts[first], ends[first] - starts[first] + 1, high[first], final[first]
        begin = np.concatenate([[0], np.cumsum(size)])
        j = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        place = np.repeat(s, size) + j
        byte = low[place]
        byte[begin[1:] - 1] = np.where(final, END, SPACE)
        _, inverse = powers(len(sums))
        so_far = mixed((sums[place] - np.repeat(sums[s], size)) * np.repeat(inverse[s], size) + j.astype(np.uint64))  # span_hash(sums, s[of], place)
        high = np.repeat(high, size)
        high[j >= NEAR] &= ~_LOW
        del sums
        first, step = _distinct(mixed(so_far + high * _K[8]) + byte * _K[10])
        j, place, byte, so_far, high = (x[first] for x in (j, place, byte, so_far, high))
        follows, back = byte.astype(np.uint64), [np.where(j > k, low[place - k - 1], 0).astype(np.uint64) << np.uint64(8 * k) for k in range(3)]
        two = back[0] | back[1]
        pairs = [_context(0, two | high << np.uint64(32)) | follows, _context(1, two | back[2] | (high & _LOW) << np.uint64(32)) | follows]
        pairs.append(_context(LEADS, so_far) | follows)
        return cls(pairs, byte, step.astype(np.int32), begin, token, at, np.add.reduceat((ends - starts + 1), at[:-1]) if len(per) else per)

    def entries(self, count: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
        """(distinct pairs of all predictors, ascending; of each predictor, decision -> pair; counts of the pairs, if those of decisions are given)"""
        found, of, n = [], [], 0
        for p in self.pairs:
            first, own = _distinct(mixed(p))  # pairs of a context are alike in their upper bits, which _distinct() sorts by
            found.append(p[first])
            of.append(own + n)
            n += len(first)
        pair = np.concatenate(found)
        order = np.argsort(pair)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = [rank.take(o) for o in of]
        return pair[order], of, None if count is None else sum(np.bincount(o, weights=count, minlength=len(pair)) for o in of)

    def counts(self, words: np.ndarray | None = None) -> np.ndarray:
        """How often each decision occurs in the words for which `words` is set."""
        tokens = np.bincount(self.token, weights=words, minlength=len(self.begin) - 1)
        return np.bincount(self.step, weights=np.repeat(tokens, np.diff(self.begin)), minlength=len(self.byte))


@dataclass
class Children:
    """The bytes that followed each of some contexts, and how often."""

    start: np.ndarray
    byte: np.ndarray
    count: np.ndarray


def rated(pair: np.ndarray, of: np.ndarray, children: Children, less: int = 0) -> np.ndarray:
    """(pairs, 8): for each bit of a pair's byte, the stretched prediction that it comes; the lowest five bits are the gate.

    of: the place of each pair's context in children; less: occurrences of the pair itself to be left out.
    """
    out = np.empty((len(of), 8), np.uint32)
    for a in range(0, len(of), PIECE):
        part = slice(a, a + PIECE)
        start, n = children.start[of[part]], children.start[of[part] + 1] - children.start[of[part]]
        who = np.repeat(np.arange(len(n)), n)
        child = np.arange(len(who)) + np.repeat(start - (np.cumsum(n) - n), n)
        shared = _SHARED[(pair[part] & _LOW).astype(np.uint8)[who] ^ children.byte[child]]
        m = np.bincount(who * 9 + shared, weights=children.count[child], minlength=9 * len(n)).reshape(-1, 9)
        other = m[:, :8].astype(np.float32)
        same = np.cumsum(m[:, :0:-1], axis=1)[:, ::-1].astype(np.float32)
        same = np.maximum(0, same - np.float32(less)) if less else same
        gate = ((same + other).view(np.int32) >> 23) - 126  # the binary digits of a count
        np.clip(gate, 0, SEEN - 1, out=gate)
        gate += np.int32(SEEN) * ((same > 0) & (other > 0))
        v = np.log((same + np.float32(0.05)) / (other + np.float32(0.05)))
        out[part] = (v.view(np.uint32) & ~np.uint32(31)) | gate.astype(np.uint32)
    return out


def _contexts(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct context of ascending pairs begins, the number of each pair's context)"""
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] ^ pair[:-1]) > _LOW
    return np.flatnonzero(new), np.cumsum(new) - 1


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -np.float32(REACH), np.float32(REACH))))


def _knot(x: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(x, -np.float32(REACH), np.float32(REACH)) + np.float32(REACH)) * np.float32((KNOTS - 1) / (2 * REACH))).astype(np.int64)


def _mixed(got: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(mixed predictions, the place of each weight that was used, the predictions)"""
    lead = (got[LEADS] & np.uint32(31)).astype(np.int64) * GATES
    at, said = [lead + (g & np.uint32(31)) for g in got], [(g & ~np.uint32(31)).view(np.float32) for g in got]
    x = np.zeros(lead.shape, np.float32)
    for v, w, a in zip(said, weights, at):
        x += w.take(a, mode="clip") * v
    return x, at, said


def _nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each bit in the tree of a byte's bits times KNOTS, bit), eight to a byte."""
    return _NODE.take(byte, axis=0), _ONE.take(byte, axis=0)


@dataclass
class Model:
    weights: np.ndarray  # by predictor, leading gate and own gate
    refined: np.ndarray  # probability of a one after (node, knot of the mixed prediction)

    def bits(self, events: Events, rates: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
        """Bits of each decision; rates: rated() of the pairs, of: for each predictor, decision -> pair."""
        out, refined, weights = np.zeros(len(events.byte)), self.refined.astype(np.float32).ravel(), self.weights.astype(np.float32)
        for a in range(0, len(out), BATCH):
            part = slice(a, a + BATCH)
            x, _, _ = _mixed([rates.take(o[part], axis=0) for o in of], weights)
            node, one = _nodes(events.byte[part])
            p = refined.take(node + _knot(np.where(one, x, -x)), mode="clip")
            p = (_squash(x) + np.where(one, p, 1 - p)) * np.float32(0.5)
            out[part] = -np.log2(p).sum(1, dtype=np.float64)
        return out


def learned(e: Events, many: np.ndarray, rates: np.ndarray, of: list[np.ndarray], rate: float = 0.05) -> np.ndarray:
    """What one walk over decisions teaches: (use of the weights, weights times use, what came after which prediction).

    many: how often each decision occurs. The weights are corrected after every BATCH of them.
    """
    weights = np.full((PREDICTORS, GATES * GATES), 0.2, np.float32)
    square, used, refined = np.full(weights.shape, 1e-4), np.zeros(weights.shape), np.zeros((2, 256 * KNOTS))
    who = np.flatnonzero(many)
    for a in range(0, len(who), BATCH):
        part = who[a : a + BATCH]
        got = [rates.take(o[part], axis=0) for o in of]
        x, at, said = _mixed(got, weights)
        c = np.repeat(many[part].astype(np.float32), 8)
        node, one = _nodes(e.byte[part])
        place = (node + _knot(np.where(one, x, -x))).ravel()
        refined[0] += np.bincount(place, weights=c, minlength=256 * KNOTS)
        refined[1] += np.bincount(place, weights=c * one.ravel(), minlength=256 * KNOTS)
        error, total = c * (1 - _squash(x)).ravel(), c.sum()
        for k, v in enumerate(said):
            cell = at[k].ravel()
            step = np.bincount(cell, weights=error * v.ravel(), minlength=GATES * GATES) / total
            square[k] += step * step
            weights[k] += rate * step / np.sqrt(square[k])
            used[k] += np.bincount(cell, weights=c, minlength=GATES * GATES)
    return np.concatenate([used.ravel(), (weights * used).ravel(), refined.ravel()])


def model_of(total: np.ndarray | None) -> Model:
    """The model that a sum of learned() makes; without any, every bit has probability one half."""
    if total is None:
        return Model(np.zeros((PREDICTORS, GATES * GATES)), np.full((256, KNOTS), 0.5))
    n = PREDICTORS * GATES * GATES
    used, weights, (seen, ones) = total[:n], total[n : 2 * n], total[2 * n :].reshape(2, 256, KNOTS)
    middle = 1 / (1 + np.exp(-(np.arange(KNOTS) / (KNOTS - 1) * 2 - 1) * REACH))[None, :]
    weights = np.where(used > 0, weights / np.maximum(used, 1e-9), 0.2).reshape(PREDICTORS, -1)
    return Model(weights, np.clip((ones + 4 * middle) / (seen + 4), 1e-6, 1 - 1e-6))


# ---------------------------------------------------------------- counts of the corpus, and the scores


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then their second bytes, and so on: what is alike compresses."""
    return np.ascontiguousarray((x if x.ndim == 2 else x.view(np.uint8).reshape(len(x), -1)).T)


def _values(raw: bytes, kind: type, n: int, at: int, width: int | None = None) -> np.ndarray:
    """n values of _planes() that begin at a place; width: bytes of each that were sent, the upper ones of a value."""
    size = np.dtype(kind).itemsize
    out = np.zeros((n, size), np.uint8)
    width = width or size
    out[:, size - width :] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
    return out.view(kind).ravel()


class Chunk:
    """A chunk's texts, their decisions, and what it asks the buckets for; counted: also how often they occur in training texts."""

    def __init__(self, docs: pa.Table, bits: int, counted: bool = True):
        self.docs = docs.combine_chunks().sort_by("uid")
        self.held = self.docs.column("held").to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = flat(self.docs.column("text"))
        self.events = Events.of_texts(data, offsets)
        e = self.events
        self.n_tokens = np.diff(e.at) + (e.size > 1)  # an empty text has one token, the end
        self.doc = np.repeat(np.arange(len(self.held)), np.diff(e.at))
        del data
        self.many = e.counts(~self.held[self.doc]) if counted else None
        self.pair, self.of, self.count = e.entries(self.many)
        self.first, self.context = _contexts(self.pair)
        self.bucket = (self.pair[self.first] >> np.uint64(63 - bits)) >> np.uint64(1)

    def rows(self) -> pa.Table:
        """One row a bucket: contexts, how many bytes follow each, these bytes and their counts in training texts."""
        chunk, out = self.docs.column("chunk")[0].as_py(), []
        ends = np.append(self.first, len(self.pair))
        seven = self.pair[self.first].view(np.uint8).reshape(-1, 8)[:, 1:]
        width = np.diff(ends).astype(np.uint16)
        counts = np.minimum(self.count, 0xFFFFFFFF).astype(np.uint32)
        for b, s in sliced_rows(self.bucket):
            lo, hi = int(ends[s.start]), int(ends[s.stop])
            out.append((b, chunk, _pack(_planes(seven[s]), _planes(width[s]), (self.pair[lo:hi] & _LOW).astype(np.uint8), _planes(counts[lo:hi])), s.stop - s.start, 0 if out else int((~self.held).sum())))
        if self.many.any():
            own = Children(ends, (self.pair & _LOW).astype(np.uint8), self.count)
            taught = learned(self.events, self.many, rated(self.pair, self.context, own, 1), self.of)
            out.append((-1 - chunk // FAN_IN, chunk, _pack(taught), 0, 0))
        if 0 not in {r[0] for r in out}:
            out.append((0, chunk, _pack(), 0, 0))  # the bucket that brings the model
        return binary_rows(out, _NAMES, _KINDS)

    def children(self, answers: pa.Table) -> Children:
        widths, follows, counts, cuts = {}, {}, {}, dict(sliced_rows(self.bucket))
        for b, raw in zip(answers.column("bucket").to_pylist(), answers.column("said").to_pylist()):
            if b not in cuts:
                continue
            n = cuts[b].stop - cuts[b].start
            raw = zstandard.decompress(raw)
            widths[b] = _values(raw, np.uint16, n, 0)
            total = int(widths[b].sum())
            follows[b], counts[b] = np.frombuffer(raw, np.uint8, total, 2 * n), _values(raw, np.uint64, total, 2 * n + total)
        order = sorted(cuts)
        return Children(np.concatenate([[0], *(widths[b].astype(np.int64) for b in order)]).cumsum(), np.concatenate([follows[b] for b in order]), np.concatenate([counts[b] for b in order]).astype(np.float64))


_NAMES = ["bucket", "chunk", "pairs", "contexts", "texts"]
_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
_SAID, _SAID_KINDS = ["chunk", "bucket", "said"], [pa.int32(), pa.int32(), pa.binary()]
_TALLY, _TALLY_KINDS = ["bucket", "taught", "tokens", "known"], [pa.int32(), pa.binary(), pa.int64(), pa.int64()]
_SUMS = "bucket int, taught binary, tokens bigint, known bigint"
_SENT = "bucket int, chunk int, pairs binary, contexts bigint, texts bigint"


def _sent(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, how many bytes follow each, these bytes, their counts) of a chunk's row of n contexts."""
    raw = zstandard.decompress(raw)
    widths = _values(raw, np.uint16, n, 7 * n).astype(np.int64)
    total = int(widths.sum())
    return _values(raw, np.uint64, n, 0, 7), widths, np.frombuffer(raw, np.uint8, total, 9 * n), _values(raw, np.uint32, total, 9 * n + total)


def _counted(table: pa.Table) -> pa.Table:
    """To each chunk of one bucket, the bytes that followed its contexts. What chunks learned, below bucket 0, has no answer."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in _NAMES)), key=lambda r: r[1])
    if rows[0][0] < 0:
        return binary_rows([], _SAID, _SAID_KINDS)
    contexts, pairs, counts = [], [], []
    for _, _, raw, n, _ in rows:
        own, widths, follows, count = _sent(raw, n)
        contexts.append(own)
        pairs.append(np.repeat(own, widths) | follows)
        counts.append(count)
    pair, count = np.concatenate(pairs), np.concatenate(counts).astype(np.float64)
    some = count > 0
    pair, count = pair[some], count[some]
    order = np.argsort(pair)
    pair = pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    total = np.add.reduceat(count[order], np.flatnonzero(new)) if len(pair) else count
    pair = pair[new]
    follows, sums = (pair & _LOW).astype(np.uint8), total.astype(np.uint64)
    out = []
    for r, c in zip(rows, contexts):
        lo, hi = np.searchsorted(pair, c), np.searchsorted(pair, c | _LOW, "right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        out.append((r[1], r[0], _pack(_planes(n.astype(np.uint16)), follows[at], _planes(sums[at]))))
    return binary_rows(out, _SAID, _SAID_KINDS)


def _tallied(table: pa.Table) -> pa.Table:
    """One row of what a bucket adds to the sums: training tokens and how many differ, or, below bucket 0, what chunks learned."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in _NAMES)), key=lambda r: r[1])
    if rows[0][0] < 0:
        return binary_rows([(rows[0][0], _summed(r[2] for r in rows), 0, 0)], _TALLY, _TALLY_KINDS)
    ended, tokens = [], sum(r[4] for r in rows)
    for _, _, raw, n, _ in rows:
        contexts, widths, follows, counts = _sent(raw, n)
        at = np.flatnonzero(((follows == SPACE) | (follows == END)) & (counts > 0))
        context = contexts[np.searchsorted(np.cumsum(widths), at, "right")]
        words = ((context >> np.uint64(8)) & np.uint64(3) == LEADS) & (context != _NO_WORD)
        tokens += int(counts[at[words]].sum(dtype=np.int64))
        ended.append(context[words])
    return binary_rows([(rows[0][0], None, tokens, len(np.unique(np.concatenate(ended))))], _TALLY, _TALLY_KINDS)


def _summed(parts) -> bytes | None:
    """The sum of packed arrays; None if there are none."""
    some = [np.frombuffer(zstandard.decompress(p)) for p in parts if p is not None]
    return _pack(np.sum(some, axis=0)) if some else None


def _total(table: pa.Table) -> pa.Table:
    """The sum of some rows of _tallied()."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in _TALLY)), key=lambda r: r[0])
    return binary_rows([(rows[0][0], _summed(r[1] for r in rows), sum(r[2] for r in rows), sum(r[3] for r in rows))], _TALLY, _TALLY_KINDS)


def score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    held_out: rows that are not learned from (none, if not given); scores are log10 probabilities.
    """
    held_out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    size = measured(docs, text_col)
    bits = bucket_bits(size)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held"))
    rows = chunked(docs, size, "id", "text", "held")

    def send(d: pa.Table) -> pa.Table:
        return Chunk(d, bits).rows()

    def both(d: pa.Table, a: pa.Table) -> pa.Table:
        names, kinds = ["id", "held_out", "n_tokens", "n_known", "logs", "bits", "size"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        if not d.num_rows:
            return binary_rows([], names, kinds)
        c = Chunk(d, bits, counted=False)
        brought = [m for m in a.column("model").to_pylist() if m is not None]
        model = model_of(np.frombuffer(zstandard.decompress(brought[0])) if brought else None)
        e, children, n = c.events, c.children(a), len(c.held)
        # a word's count is that of what ends it after the whole word
        ends = np.where((children.byte == SPACE) | (children.byte == END), children.count, 0.0)
        ended = np.concatenate([[0.0], np.cumsum(ends)])[children.start]
        count = np.diff(ended)[c.context[c.of[LEADS][e.step[e.begin[1:] - 1]]]]
        count, some = np.rint(count[e.token]), np.repeat(e.size > 1, np.diff(e.at))
        known = np.bincount(c.doc, weights=some & (count > 0), minlength=n).astype(np.int64)
        logs = np.bincount(c.doc, weights=np.where(some, np.log10(count + 0.1), 0.0), minlength=n)
        of_decision = model.bits(e, rated(c.pair, c.context, children), c.of)
        of_token = np.add.reduceat(of_decision[e.step], e.begin[:-1])
        total = np.add.reduceat(of_token[e.token], e.at[:-1])
        return pa.table([c.docs.column("id"), c.docs.column("held"), pa.array(c.n_tokens.astype(np.int64)), pa.array(known), pa.array(logs), pa.array(total), pa.array(e.size.astype(np.int64))], names=names)

    # both steps read one exchange; answers are made in one of them only
    sent = rows.groupBy("chunk").applyInArrow(send, _SENT).groupBy("bucket")
    # one row in the end, whatever the number of chunks: a step adds FAN_IN rows
    sums = sent.applyInArrow(_tallied, _SUMS).groupBy(F.floor(F.col("bucket") / FAN_IN)).applyInArrow(_total, _SUMS).groupBy().applyInArrow(_total, _SUMS)
    said = sent.applyInArrow(_counted, "chunk int, bucket int, said binary")
    answers = said.select("chunk", "bucket", "said", F.when(F.col("bucket") == 0, sums.select("taught").scalar()).alias("model"))
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, bits double, size bigint")
    ended = docs.where("not held").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()  # how often the end token was seen
    n, v = F.coalesce(sums.select("tokens").scalar(), F.lit(0)), F.coalesce(sums.select("known").scalar(), F.lit(0)) + F.when(ended > 0, 1).otherwise(0)
    out = out.withColumn("train_tokens", n).withColumn("n_known", F.col("n_known") + F.when(ended > 0, 1).otherwise(0))
    out = out.withColumn("base_score", F.col("logs") + F.log10(ended + 0.1) - F.col("n_tokens") * F.log10(n + 0.1 * (v + 1)))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / F.col("size")).alias("bits_per_byte"))
