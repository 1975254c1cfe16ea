"""Fill-in-middle transformation by rank and select on packed boundary bits.

A batch of texts is one run of bytes with two packed bitvectors over it: one bit where a line starts,
one where a code point starts. A directory holds the popcounts before each 64-bit word. The rank at a
text's two ends gives its number of lines; a cut after k lines is the byte of the (k+1)-th set bit
(select: a search of the directory, then within one word); the code points of a piece are a
difference of ranks. So a text is cut by bytes, never decoded or split into lines.

The cuts come from a hash of the document's id, so reruns agree. Nulls: a null text is an empty one,
a null id hashes as one without digits. An empty text, and one that holds a sentinel, stays as it is
(plain). A text of one line or of millions is cut alike; repeated rows are cut alike; empty tables
give no rows. Columns beyond id and text are dropped, whatever their names. The step is a map over
rows without a shuffle; a task takes some four times the bytes of its longest text, or of SLICE_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What the id is hashed with, the share of texts that are transformed and of those in suffix-first form.
SEED, RATE, SPM = "7", 100, 50
_NEWLINE = 10


class Bits:
    """A packed bitvector with rank and select; bit i is bit i % 64 of word i // 64."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)  # one word more than full ones, so rank(len) has a word
        self.words.view(np.uint8)[: len(raw)] = raw
        counts = np.bitwise_count(self.words)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(counts, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th set bit, counted from 0; k is below the total."""
        word = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[word]
        bits, at = self.words[word], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # halves of the word: go on in the upper one if the lower holds too few
            low = bits & ((np.uint64(1) << np.uint64(step)) - np.uint64(1))
            count = np.bitwise_count(low).astype(np.int64)
            up = left >= count
            left = np.where(up, left - count, left)
            at += np.where(up, step, 0)
            bits = np.where(up, bits >> np.uint64(step), low)
        return (word << 6) + at


def _cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """(lines, byte of the first cut, byte of the second, code points of prefix and of middle) of each text."""
    begin, end = offsets[:-1], offsets[1:]
    starts = np.zeros(len(data), bool)
    starts[1:] = data[:-1] == _NEWLINE
    starts[begin[begin < end]] = True
    lines, points = Bits(starts), Bits((data & 0xC0) != 0x80)
    base = lines.rank(begin)
    n = lines.rank(end) - base
    a, b = h1 % (n + 1), h2 % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        out = end.copy()
        inner = np.flatnonzero(k < n)
        out[inner] = lines.select(base[inner] + k[inner])
        return out

    first, second = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    return n, first, second, points.rank(first) - points.rank(begin), points.rank(second) - points.rank(first)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every text.

    n: lines; form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle). rate: percent
    of texts that are transformed; spm: percent of those in the suffix-first form. restored() undoes it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= rate)
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"),
        F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"),
    )
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n, first, second, prefix, middle = _cuts(own, ends, part.column(2).to_numpy(), part.column(3).to_numpy())
                raw, forms, out = own.tobytes(), part.column(4).to_pylist(), []
                for form, a, b, c, d in zip(forms, ends[:-1].tolist(), first.tolist(), second.tolist(), ends[1:].tolist()):
                    if form == "plain":
                        out.append(raw[a:d])
                    elif form == "psm":
                        out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                    else:
                        out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                cut = np.array([f == "plain" for f in forms], bool)
                columns = [part.column(0), pa.array(n), part.column(4), pa.array(prefix, mask=cut), pa.array(middle, mask=cut), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A transformed text holds no sentinel, and no sentinel starts within another one, so the first
    place of each is the one that was put in.
    """
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    size = len(PREFIX)  # all three are as long

    def between(a: Column, b: Column) -> Column:
        return F.substring(output, a + size, b - a - size)

    middle = F.substring(output, m + size, F.length(output))
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
