"""Vector files as Spark data sources.

"vecbin": int32 rows, int32 dims, then all values row by row. "vecs" (fvecs, bvecs, ivecs): int32
dims before each row. Reading yields (id, vec), where id is the row's place in the file, in partitions
of row ranges; writing sorts nothing: each task writes a part, and commit joins parts in order of
their ids. Option dtype is float, int8 or uint8 (vecbin), and float, uint8 or int32 (vecs).

These files are single by format, so their reader opens them by a path that all workers share.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: name -> (numpy type, Spark element)
KINDS = {"float": ("<f4", "float"), "int8": ("<i1", "tinyint"), "uint8": ("<u1", "smallint"), "int32": ("<i4", "int")}
_ARROW = {"float": pa.float32(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32()}
ROWS = 65_536


def _kind(options) -> str:
    kind = options.get("dtype", "float")
    if kind not in KINDS:
        raise ValueError(f"dtype must be one of {sorted(KINDS)}, not {kind!r}")
    return kind


def metadata(path: str) -> tuple[int, int]:
    """(rows, dims) of a vecbin file."""
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path} is too short for a header")
    return struct.unpack("<ii", head)


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, framed: bool):
        self.path, self.kind, self.framed = path, kind, framed

    def _shape(self) -> tuple[int, int, int]:
        """(rows, dims, bytes of a row)"""
        width = np.dtype(KINDS[self.kind][0]).itemsize
        if not self.framed:
            n, d = metadata(self.path)
            if os.path.getsize(self.path) < 8 + n * d * width:
                raise ValueError(f"{self.path} is shorter than its header says")
            return n, d, d * width
        size = os.path.getsize(self.path)
        if size == 0:
            return 0, 0, 4
        with open(self.path, "rb") as f:
            d = struct.unpack("<i", f.read(4))[0]
        if size % (4 + d * width):
            raise ValueError(f"{self.path} does not hold whole rows of {d} values")
        return size // (4 + d * width), d, 4 + d * width

    def partitions(self):
        n = self._shape()[0]
        return [Range(a, min(a + ROWS, n)) for a in range(0, n, ROWS)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        _, d, row = self._shape()
        count = partition.stop - partition.start
        if not count:
            return
        with open(self.path, "rb") as f:
            f.seek((0 if self.framed else 8) + partition.start * row)
            raw = np.frombuffer(f.read(count * row), np.uint8).reshape(count, row)
        kind, element = KINDS[self.kind]
        values = np.ascontiguousarray(raw[:, 4 * self.framed :]).view(kind).reshape(-1)
        flat = pa.array(values.astype(np.int16) if element == "smallint" else values, _ARROW[element])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, count * d + 1, d), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.start, partition.stop)), lists], ["id", "vec"])


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int
    dims: int
    first: int


class _Writer(DataSourceArrowWriter):
    """Parts next to the target; commit appends them in order of their first id and removes them."""

    def __init__(self, path: str, kind: str, framed: bool):
        self.path, self.kind, self.framed = path, kind, framed

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        part, rows, dims, first = f"{self.path}.part-{uuid.uuid4().hex}", 0, 0, -1
        with open(part, "wb") as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = batch.column(batch.schema.get_field_index("id"))
                first = order[0].as_py() if first < 0 else first
                vec = batch.column(batch.schema.get_field_index("vec"))
                x = vec.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(KINDS[self.kind][0])
                rows, dims = rows + len(x), x.shape[1]
                if self.framed:
                    head = np.full((len(x), 1), dims, "<i4").view(np.uint8).reshape(len(x), 4)
                    f.write(np.concatenate([head, x.view(np.uint8).reshape(len(x), -1)], axis=1).tobytes())
                else:
                    f.write(x.tobytes())
        return Part(part, rows, dims, first)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        if len({m.dims for m in parts}) > 1:
            self.abort(messages)
            raise ValueError("vectors differ in length")
        with open(self.path, "wb") as out:
            if not self.framed:
                out.write(struct.pack("<ii", sum(m.rows for m in parts), parts[0].dims if parts else 0))
            for m in parts:
                with open(m.path, "rb") as f:
                    while chunk := f.read(1 << 24):
                        out.write(chunk)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class VecBin(DataSource):
    framed = False

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return f"id bigint, vec array<{KINDS[_kind(self.options)][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], _kind(self.options), self.framed)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options["path"]
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} exists")
        return _Writer(path, _kind(self.options), self.framed)


class Vecs(VecBin):
    framed = True

    @classmethod
    def name(cls) -> str:
        return "vecs"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecBin)
    spark.dataSource.register(Vecs)


def read(spark: SparkSession, path: str, dtype: str = "float", kind: str = "vecbin"):
    """(id, vec) of a vecbin or vecs file."""
    register(spark)
    return spark.read.format(kind).option("dtype", dtype).load(path)


def write(vectors, path: str, dtype: str = "float", kind: str = "vecbin") -> None:
    """vectors(id, vec) as one file, in order of id."""
    register(vectors.sparkSession)
    vectors.select("id", "vec").repartitionByRange("id").sortWithinPartitions("id").write.format(kind).option("dtype", dtype).mode("overwrite").save(path)
