"""Packed exchange between chunks of documents and buckets of a hash space.

Operators that compare short units (word windows, tokens) of all documents have too many of them
for rows. Here documents are dealt into chunks of bounded size; a chunk packs what it has for each
bucket of the hash space into one binary row, and a bucket answers each chunk in one binary row.
Within a chunk every value is sent once, so a value that a third of all documents share reaches its
bucket once a chunk. The text of a chunk is shuffled once: all steps read the same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that make a chunk, rows of one at most about, and bytes of text that make a bucket.
CHUNK, ROWS, BUCKET = 3500 << 10, 50_000, 13 << 20


def measured(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, bytes of text) of docs: one pass, on the JVM."""
    text = F.col(text_col).cast("string")
    found = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))).first()
    return found[0], found[1]


def chunked(docs: DataFrame, size: tuple[int, int], id_col: str, text_col: str, *more: str) -> DataFrame:
    """(chunk, uid, id, text, more...): each row in one of so many chunks that each holds about CHUNK bytes and ROWS rows at most.

    size: measured(docs). A text is never cut, so a longer one makes its chunk that much larger.
    """
    n = max(1, -(-size[0] // ROWS), -(-size[1] // CHUNK))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *more).withColumn("uid", F.monotonically_increasing_id())
    return rows.select(F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("chunk"), "uid", "id", "text", *more)


def bucket_bits(size: tuple[int, int], each: int = BUCKET) -> int:
    """log2 of a number of buckets of about `each` bytes of text; size: measured(docs)."""
    return max(0, (-(-size[1] // each) - 1).bit_length())


def sliced_rows(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """(bucket, slice) of the non-empty buckets; bucket is ascending."""
    if not len(bucket):
        return []
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:])]


def to_deltas(values: np.ndarray) -> bytes:
    """Ascending unsigned 32-bit values as 16-bit steps; 0xFFFF alone means a step of that size to nothing."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    long = gaps // 0xFFFF
    out = np.full(len(values) + int(long.sum()), 0xFFFF, np.uint16)
    out[np.cumsum(long + 1) - 1] = gaps % 0xFFFF
    return out.tobytes()


def from_deltas(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 0xFFFF]


def binary_rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
