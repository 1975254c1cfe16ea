"""Byte-level BPE encoding and decoding by a segment tree.

A piece (one match of the splitting pattern) starts as single bytes. The leaf of byte position i
holds the rank of the pair that starts there, and each inner node the smaller of its children, so
the root names the lowest rank and a walk that prefers the left child finds its leftmost place. A
merge changes the pairs at two live neighbours and takes the merged one away: three updates of
logarithmic cost, which makes a piece of n bytes O(n log n) even where a text is one long run.

Nulls: a null text is encoded as an empty one (no tokens, empty decoded bytes). Empty texts have no
tokens. Repeated rows are encoded each; extra columns are dropped. The step is a map over rows
without a shuffle; a worker's cache of pieces has a fixed bound.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Half of the pieces that a worker remembers at most; each is a short string and its ids.
CACHE = 250_000
#: Longer pieces are not remembered.
CACHED_LEN = 64
_NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Bpe(dict):
    """Encoder for one rank file; as a dict, it maps a piece to the packed ids of its tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ranks, self.longest = ranks, max(map(len, ranks), default=1)
        self.find = regex.compile(pattern).findall
        self.tokens = {v: k for k, v in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            tokens = (rank,) if rank is not None else self.merge(raw)
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(piece) <= CACHED_LEN:
            if len(self) >= CACHE:  # pieces that come again move from the older half to the newer one
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        n, rank_of, longest, none = len(raw), self.ranks.get, self.longest, _NONE
        size = 1 << max(0, n - 2).bit_length()
        tree = [none] * size
        tree += [rank_of(raw[i : i + 2], none) for i in range(n - 1)]
        tree += [none] * (2 * size - len(tree))
        for i in range(size - 1, 0, -1):
            a, b = tree[i + i], tree[i + i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while (best := tree[1]) != none:
            at = 1
            while at < size:
                at += at
                if tree[at] != best:
                    at += 1
            i = at - size
            gone = after[i]
            end = after[gone]
            after[i] = end
            before[end] = i
            # the leaves of the neighbours that now pair anew, and of the token that is no more
            if end < n:
                far = after[end]
                tree[at] = rank_of(raw[i:far], none) if far - i <= longest else none
                k = size + gone
                if tree[k] != none:
                    tree[k] = none
                    k >>= 1
                    while k:
                        a, b = tree[k + k], tree[k + k + 1]
                        if b < a:
                            a = b
                        if tree[k] == a:
                            break
                        tree[k] = a
                        k >>= 1
            else:
                tree[at] = none
            k = at >> 1
            while k:
                a, b = tree[k + k], tree[k + k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
            p = before[i]
            if p >= 0:
                k = size + p
                new = rank_of(raw[p:end], none) if end - p <= longest else none
                if tree[k] != new:
                    tree[k] = new
                    k >>= 1
                    while k:
                        a, b = tree[k + k], tree[k + k + 1]
                        if b < a:
                            a = b
                        if tree[k] == a:
                            break
                        tree[k] = a
                        k >>= 1
        out, i, ranks = [], 0, self.ranks
        while i < n:
            end = after[i]
            out.append(ranks[raw[i:end]])
            i = end
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the tokens as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Bpe] = {}


def encoder(path: str, pattern: str) -> Bpe:
    """One encoder for each worker; the vocabulary file is read where the worker runs."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every text: ids packed as unsigned 32-bit little-endian integers.

    path: a rank file that every worker can read; pattern: the regex that splits texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(x) if x else b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary").withColumnRenamed("doc_id", id_col)
