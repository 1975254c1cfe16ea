"""Exact deduplication by content-defined chunk recipes.

A normalised text is cut where a rolling hash of the last 16 bytes has its low bits clear, so equal
stretches are cut alike wherever they stand. Every distinct chunk gets a verified identifier: chunks
of one hash are compared byte by byte (as the smallest and the largest content under the hash), and
where they differ a second, longer digest tells them apart. A text is then a recipe, the ordered
list of its chunks' identifiers; recipes are grouped and compared instead of texts. Contents cross
the network once, reduced to one copy a hash and task; recipes are a few bytes a kilobyte of text.

Nulls: a null text counts as empty; empty texts are equal. Of rows that repeat an id and a text one
is kept. Rows with different texts under one id are separate rows. An empty table gives no rows. Extra
columns are dropped, whatever their names. A text stays whole: a task takes a few times the bytes of
its longest one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, written

#: A cut every so many bytes on average, and the least and most bytes between two.
AVERAGE, LEAST, MOST = 2048, 512, 8192
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_RUNS = re.compile(rb"[\t-\r][\t-\r ]*| [\t-\r ]+")


def normalised(raw: bytes) -> bytes:
    """Each run of white space replaced by one space."""
    return _RUNS.sub(b" ", raw)


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; none for an empty one."""
    n = len(data)
    if n == 0:
        return []
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):  # after the four steps, h covers 16 bytes
        h[shift:] += h[:-shift] << np.uint32(shift)
    marks = np.flatnonzero(h & np.uint32((AVERAGE - 1) << 5) == 0) + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n:
            if m > last:
                out.append(m)
            last = m
    return out


def _chunks(raw: bytes) -> list[bytes]:
    ends = cut_points(np.frombuffer(raw, np.uint8))
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _short(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def _long(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def _texts(column) -> Iterator[bytes]:
    data, offsets = flat(column)
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield normalised(whole[a:b])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short=_short, uid: Column | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, uid) of every row.

    short: the 64-bit chunk hash (tests put a weak one in its place). uid: what numbers the rows
    of docs; whoever joins the result with docs gives a column of a written table (common.numbered).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string").alias("text")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = {(short(c), c) for x in _texts(batch.column(0).slice(at, 512)) for c in _chunks(x)}
                rows = sorted(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "content"])

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, digests, longs = [], [], []
            for x in _texts(batch.column(2)):
                parts = _chunks(x)
                shas.append(hashlib.sha256(x).hexdigest())
                digests.append([short(c) for c in parts])
                longs.append([_long(c) for c in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(digests, pa.list_(pa.int64())), pa.array(longs, pa.list_(pa.int64()))], ["id", "uid", "sha", "digests", "longs"])

    rows = docs.select(F.col(id_col).alias("id"), (F.monotonically_increasing_id() if uid is None else uid).alias("uid"), text)
    rows = written(rows.mapInArrow(recipes, f"id {kind}, uid bigint, sha string, digests array<bigint>, longs array<bigint>"))

    found = docs.select(text).mapInArrow(contents, "digest bigint, content binary").groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    # hashes under which contents differ; a table of their own, so that Spark sees how few there are
    clashes = written(found.where("a <> b").select("digest", F.lit(True).alias("clash")))
    parts = rows.select("uid", F.posexplode(F.arrays_zip("digests", "longs")).alias("seq", "part"))
    parts = parts.select("uid", "seq", F.col("part.digests").alias("digest"), F.col("part.longs").alias("extra")).join(clashes, "digest")
    told = parts.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("seq", "extra"))).alias("told"))
    # a recipe: the chunks' hashes, and the second digests of those whose hash does not tell
    extra = F.transform("digests", lambda d, seq: F.coalesce(F.element_at("told", seq), F.lit(0).cast("bigint")))
    recipe = F.when(F.col("told").isNull(), F.col("digests")).otherwise(F.concat("digests", extra))
    lists = written(rows.join(told, "uid", "left").select("id", "uid", "sha", recipe.alias("recipe")))

    # a table of its own too: the join then deals both sides anew, and Spark can split a large group's rows
    same = written(lists.groupBy("recipe").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"), F.count(F.lit(1)).alias("group_size")))
    out = lists.join(same, "recipe")
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "uid")
