"""Helpers that several operators share: Arrow text as flat bytes, word hashing, shared tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written

#: White space that ends a word: 0x20 and 0x09-0x0D.
WS_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WS = np.zeros(256, bool)
IS_WS[list(WS_BYTES)] = True

#: Texts are worked on in slices of about so many bytes, which keeps numpy's arrays in the cache.
SLICE_BYTES = 1 << 20
#: Values of a long array that are worked on together.
PIECE = 1 << 13

_M = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


# ---------------------------------------------------------------- Spark side


def numbered(df: DataFrame, name: str = "uid") -> DataFrame:
    """df with a number for each row, written: every later scan of it finds the same numbers.

    monotonically_increasing_id() alone depends on how a scan packs files into splits, which differs
    between two scans when the cluster's cores do.
    """
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes under df (file sizes for a scan); never runs a job.

    Where Catalyst knows nothing, as for rows from Python, 8 MB for each partition.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else df.rdd.getNumPartitions() << 23


def parts_for(df: DataFrame, each: int) -> int:
    """How many parts of about `each` bytes df makes; the same for the same input."""
    return max(1, min(1 << 20, -(-plan_bytes(df) // each)))


def split_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


# ---------------------------------------------------------------- Arrow and numpy side


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (bytes, offsets of len + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(kind) if column.type != kind else column
    column = pc.fill_null(column, b"") if column.null_count else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (a, b) of about `most` bytes each; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes unchanged."""
    return _ASCII_LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in data, and where each text's words begin (len(offsets) entries)."""
    solid = ~IS_WS[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = solid[cut]
        last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values; long arrays are worked on in pieces that stay in the cache."""
    out = np.empty(h.shape, np.uint64)
    for a in range(0, len(h), PIECE):
        x = h[a : a + PIECE]
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        np.bitwise_xor(x, x >> np.uint64(31), out=out[a : a + PIECE])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_M), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)]), dtype=np.uint64) for x in (_M, inverse)]
    return _POWERS[0], _POWERS[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: any span's hash is (S[end] - S[start]) * inverse power of start."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, alike for like bytes wherever they stand."""
    _, inverse = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data), starts, ends)


def columns_of(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
