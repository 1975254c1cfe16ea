"""Binary files of neighbours: truth sets of searches and of ranges, and id maps of shards.

All begin with two int32. Truth: queries and k, then all ids (uint32), then all distances (float32)
if the file is long enough for them. Range truth: queries and the number of ids, then a count for
each query, then all ids. Id map: rows and 1, then an id a row. A file of another size is refused.
Like other single files they are opened by a path that all workers share, in blocks of rows. Writers let
each task fill in the places of its rows, so nothing is gathered or copied together.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import truth_long
from .vectors import ROWS, metadata


def _read(path: str, kind: str, at: int, n: int) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(at)
        return np.fromfile(f, kind, n)


def _ids(path: str, at: int, n: int) -> np.ndarray:
    return _read(path, "<u4", at, n).astype(np.int64)


def _refuse(path: str, expected: str) -> ValueError:
    return ValueError(f"{path} has {os.path.getsize(path)} bytes, expected {expected}")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, id, distance); distance is null if the file holds ids only."""
    n, k = metadata(path)
    cells = n * k
    if os.path.getsize(path) not in (8 + 4 * cells, 8 + 8 * cells):
        raise _refuse(path, f"{8 + 4 * cells} or {8 + 8 * cells}")
    far = os.path.getsize(path) == 8 + 8 * cells and cells > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                a, z = b * ROWS, min(n, (b + 1) * ROWS)
                lists = lambda x: pa.array(list(x.reshape(z - a, k)))
                d = lists(_read(path, "<f4", 8 + 4 * (cells + a * k), (z - a) * k).astype(np.float64)) if far else pa.nulls(z - a, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, z)), lists(_ids(path, 8 + 4 * a * k, (z - a) * k)), d], ["query_id", "ids", "distances"])

    blocks = -(-n // ROWS) if cells else 0
    return truth_long(spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, "query_id bigint, ids array<bigint>, distances array<double>"))


def read_range_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, id): the ids within range; a query without any has no row."""
    n, total = metadata(path)
    if os.path.getsize(path) != 8 + 4 * (n + total):
        raise _refuse(path, str(8 + 4 * (n + total)))
    starts, at = [], 0  # one row for each block of queries
    for a in range(0, n, ROWS):
        starts.append((a, at))
        at += int(_read(path, "<i4", 8 + 4 * a, min(ROWS, n - a)).sum(dtype=np.int64))
    if at != total:
        raise ValueError(f"{path} counts {at} ids and holds {total}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, at in zip(*(c.to_pylist() for c in batch.columns)):
                counts = _read(path, "<i4", 8 + 4 * a, min(ROWS, n - a))
                ids = _ids(path, 8 + 4 * (n + at), int(counts.sum(dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(a, a + len(counts)), counts)), pa.array(ids)], ["query_id", "id"])

    return spark.createDataFrame(starts, "a bigint, at bigint").repartition(max(1, len(starts))).mapInArrow(run, "query_id bigint, id bigint")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """(place, id): which row of the whole table each row of a shard is."""
    n, d = metadata(path)
    if d != 1 or os.path.getsize(path) != 8 + 4 * n:
        raise _refuse(path, f"{8 + 4 * n} and one dimension, not {d}")
    x = spark.read.format("vecbin").option("dtype", "int32").load(path)
    return x.select(F.col("id").alias("place"), (F.col("vec")[0].cast("bigint") % (1 << 32) + (1 << 32)).alias("id")).withColumn("id", F.col("id") % (1 << 32))


# ---------------------------------------------------------------- writing


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of runs of consecutive numbers."""
    if not len(key):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(key) != 1) + 1).tolist(), len(key)]
    return list(zip(cuts, cuts[1:]))


def _begin(path: str, a: int, b: int, size: int) -> None:
    """A new file with its two int32 and the size that it will have; tasks fill it at their places."""
    with open(path, "wb") as f:
        np.array([a, b], "<i4").tofile(f)
        f.truncate(size)


def _fill(rows: DataFrame, write) -> int:
    """Lets tasks write(file, batch) their rows, which have a place in the file; returns the rows written. A task that runs again writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            write(batch)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_truth(truth: DataFrame, path: str) -> None:
    """Writes truth(query_id, rank, id[, distance]) as one file; queries are 0, 1, ... and all have ranks 1 to k.

    Tasks write their queries at the places that their numbers give. ValueError for queries or ranks
    that are missing, before anything is written.
    """
    far = "distance" in truth.columns
    own = F.sort_array(F.collect_list(F.struct("rank", "id", *(["distance"] if far else []))))
    lists = truth.groupBy("query_id").agg(own.alias("own"))
    last, n, least, k, even, low, high = lists.agg(
        F.max("query_id"), F.count(F.lit(1)), F.min(F.size("own")), F.max(F.size("own")),
        F.bool_and(F.col("own.rank") == F.sequence(F.lit(1).cast("bigint"), F.size("own").cast("bigint")).cast(f"array<{truth.schema['rank'].dataType.simpleString()}>")),
        F.min(F.array_min("own.id")), F.max(F.array_max("own.id")),
    ).first()
    if n and (last != n - 1 or least != k or not even or low < 0 or high >= 1 << 32):
        raise ValueError("a truth file holds queries 0 to n - 1 with ranks 1 to k each and ids of 32 bits")
    n, k = n or 0, k or 0
    _begin(path, n, k, 8 + 4 * n * k * (2 if far else 1))

    def write(batch: pa.RecordBatch) -> None:
        q = batch.column(0).to_numpy()
        ids = batch.column(1).flatten().to_numpy().astype("<u4").reshape(len(q), k)
        d = batch.column(2).flatten().to_numpy().astype("<f4").reshape(len(q), k) if far else None
        with open(path, "r+b") as f:
            for a, b in _runs(q):
                f.seek(8 + 4 * k * int(q[a]))
                f.write(ids[a:b].tobytes())
                if far:
                    f.seek(8 + 4 * k * (n + int(q[a])))
                    f.write(d[a:b].tobytes())

    rows = lists.select("query_id", F.col("own.id").alias("ids"), *([F.col("own.distance").cast("array<double>").alias("distances")] if far else []))
    _fill(rows.repartitionByRange("query_id").sortWithinPartitions("query_id"), write)


def write_range_truth(pairs: DataFrame, queries: int, path: str) -> None:
    """Writes pairs(query_id, id) as one file of counts and ids; queries are 0 to queries - 1, some of them without ids."""
    from ..plans.numbering import numbered

    lists = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    every = pairs.sparkSession.range(queries).select(F.col("id").alias("query_id")).join(lists, "query_id", "left")
    every = numbered(every.select("query_id", F.coalesce("ids", F.expr("cast(array() as array<bigint>)")).alias("ids")), "query_id", place="at", before="before", value=F.coalesce(F.size("ids"), F.lit(0)))
    held, total, low, high = every.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.min(F.array_min("ids")), F.max(F.array_max("ids"))).first()
    if total != pairs.count() or held != queries or total and (low < 0 or high >= 1 << 32):
        raise ValueError(f"a range truth file of {queries} queries holds queries 0 to {queries - 1} and ids of 32 bits")
    _begin(path, queries, total, 8 + 4 * (queries + total))

    def write(batch: pa.RecordBatch) -> None:
        q, before = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        lists = batch.column(1)
        counts = np.diff(lists.offsets.to_numpy())
        ids, ends = lists.flatten().to_numpy().astype("<u4"), np.append(0, np.cumsum(counts))
        with open(path, "r+b") as f:
            for a, b in _runs(q):
                f.seek(8 + 4 * int(q[a]))
                f.write(counts[a:b].astype("<i4").tobytes())
                f.seek(8 + 4 * (queries + int(before[a])))
                f.write(ids[ends[a] : ends[b]].tobytes())

    _fill(every.select("query_id", "ids", "before").repartitionByRange("query_id").sortWithinPartitions("query_id"), write)


def write_id_map(rows: DataFrame, path: str) -> None:
    """Writes rows(place, id) as one file; places are 0, 1, ... once each."""
    n, last, distinct, low, high = rows.agg(F.count(F.lit(1)), F.max("place"), F.count_distinct("place"), F.min("id"), F.max("id")).first()
    if n and (last != n - 1 or distinct != n or low < 0 or high >= 1 << 32):
        raise ValueError("an id map holds places 0 to n - 1 once each and ids of 32 bits")
    _begin(path, n, 1, 8 + 4 * n)

    def write(batch: pa.RecordBatch) -> None:
        at, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("<u4")
        with open(path, "r+b") as f:
            for a, b in _runs(at):
                f.seek(8 + 4 * int(at[a]))
                f.write(ids[a:b].tobytes())

    _fill(rows.select("place", "id").repartitionByRange("place").sortWithinPartitions("place"), write)
