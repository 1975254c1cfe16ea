"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is set if it is set in over half of the XXH64 values (seed 42) of a text's 3-word
shingles. Fingerprints that differ in at most two bits agree in two of four 16-bit blocks, so each
distinct fingerprint goes to six lists, one for each pair of blocks and its 32-bit value. Within a
list, fingerprints are compared as bit planes: 64 fingerprints are one word of each plane, a query
bit turns a plane into a plane of differences, and carry-save counters sum 64 distances at once;
words in which every counter has passed the radius are abandoned. A list above `TILE` fingerprints
is cut into tiles, and every pair of tiles is a task's work of its own. Tasks return a spanning
forest, never the pairs.

Nulls: a null text counts as empty; texts without words have fingerprint zero and link like any
other. Of one or two words the whole sequence is the only shingle. Rows that repeat an id are rows
of their own; null ids come last when the smallest id is sought. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_WS, flat, lowered, slices, words, written
from .components import components

TILE = 1024
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b in slices(offsets):
        out[a:b] = _fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
    return out


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    starts, ends, at = words(data, offsets)
    if not len(starts):
        return out
    # words joined by one space: every white space byte after a word's last stays as a space
    solid = ~IS_WS[data]
    keep = solid.copy()
    keep[ends[ends < len(data)]] = True
    place = np.cumsum(keep) - keep
    joined = np.where(solid, lowered(data), 32).astype(np.uint8)[keep].tobytes()
    first = place[starts]
    last = first + (ends - starts)
    count = np.diff(at)
    made = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(n), made)
    k = np.arange(len(of)) - np.repeat(np.cumsum(made) - made, made) + at[:-1][of]
    end = np.minimum(k + shingle, at[1:][of]) - 1
    xx = xxhash.xxh64_intdigest
    h = np.array([xx(joined[a:b], 42) for a, b in zip(first[k].tolist(), last[end].tolist())], np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(made)
    sums = np.add.reduceat(bits, (np.cumsum(made) - made)[some], axis=0, dtype=np.int32)
    majority = (2 * sums > made[some, None]).astype(np.uint8)
    out[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def planes_of(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes by 64-lane word, lane of each value, words before each group): groups start at whole words."""
    per = -(-sizes // 64)
    before = np.cumsum(per) - per
    lane = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 64 * np.repeat(before, sizes)
    bits = np.zeros((64, int(per.sum()) * 64), np.uint8)
    bits[:, lane] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), lane, before


def near(values: np.ndarray, sizes: np.ndarray, radius: int = 2, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), both ways, of values of one group that differ in at most `radius` (1 or 2) bits.

    values: the groups' fingerprints one group after another; sizes: how many each group has.
    """
    planes, lane, before = planes_of(values, sizes)
    n_words = planes.shape[1]
    owner = np.full(n_words * 64, -1, np.int64)
    owner[lane] = np.arange(len(values))
    there = np.packbits((owner >= 0).astype(np.uint8), bitorder="little").view("<u8")
    per = -(-sizes // 64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    load = np.cumsum(per[group])
    a = 0
    while a < len(values):  # so many queries that their words fit into some MB
        b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + (1 << 18), "right")))
        q = np.repeat(np.arange(a, b), per[group[a:b]])
        w = np.arange(len(q)) - np.repeat(np.cumsum(per[group[a:b]]) - per[group[a:b]], per[group[a:b]]) + before[group[q]]
        one, two, over = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64), ~there[w]
        for plane in range(64):
            ask = -((values[q] >> np.uint64(plane)) & np.uint64(1)).astype(np.int64)
            d = planes[plane, w] ^ ask.view(np.uint64)
            carry = one & d
            one ^= d
            over |= two & carry if radius > 1 else carry
            two ^= carry
            over |= one & two if radius > 1 else two
            if plane % step == step - 1:
                live = over != _ALL
                if not live.all():
                    q, w, one, two, over = q[live], w[live], one[live], two[live], over[live]
        hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, c = np.nonzero(hit)
        i, j = q[r], owner[w[r] * 64 + c]
        found.append((i[i != j], j[i != j]))
        a = b
    return np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([y for _, y in found] or [np.zeros(0, np.int64)])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items reaches over the pairs (given both ways)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of the distinct fingerprints prints(fp) within two bits."""
    key = lambda i, j: F.shiftleft((F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)), 16).bitwiseOR(F.shiftrightunsigned("fp", 16 * j).bitwiseAND(0xFFFF))
    keys = F.array(*[key(i, j) + (n << 32) for n, (i, j) in enumerate(_PAIRS)])
    rows = written(prints.select("fp", F.explode(keys).alias("key")))
    sizes = rows.groupBy("key").count().where("count > 1").withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    # tile t meets every other tile; a list of one tile meets itself
    other = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("own")))
    rows = rows.withColumn("other", F.explode(other)).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_none(batches):
            if batch is not None:
                now = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
                now = now if rest is None else np.concatenate([rest, now])
                if not len(now):
                    continue
                change = np.flatnonzero((now[1:, :3] != now[:-1, :3]).any(1)) + 1
                cut = change[-1] if len(change) else 0  # the last group may go on
                done, rest = now[:cut], now[cut:]
            else:
                done = rest if rest is not None else np.zeros((0, 4), np.int64)
            if not len(done):
                continue
            change = np.concatenate([[0], np.flatnonzero((done[1:, :3] != done[:-1, :3]).any(1)) + 1, [len(done)]])
            values = done[:, 3].view(np.uint64) if done[:, 3].flags.c_contiguous else np.ascontiguousarray(done[:, 3]).view(np.uint64)
            label = forest(len(values), *near(values, np.diff(change)))
            on = np.flatnonzero(label != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(done[on, 3]), pa.array(done[label[on], 3])], ["a", "b"])

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "fp").mapInArrow(compare, "a bigint, b bigint")


def _and_none(batches):
    yield from batches
    yield None


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, uid: Column | None = None) -> DataFrame:
    """(id, fingerprint, component_id, kept, uid) of every row; of each group the first row by id is kept.

    uid: what numbers the rows of docs; whoever joins the result with docs gives a column of a
    written table (common.numbered).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(*flat(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["id", "uid", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), (F.monotonically_increasing_id() if uid is None else uid).alias("uid"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(run, f"id {kind}, uid bigint, fp bigint"))
    prints = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")))
    found = components(links(prints.select("fp"), tile))
    of = prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "first")
    of = written(of)
    least = written(of.groupBy("component").agg(F.min("first").alias("least")))  # so that Spark can split a large component's rows
    of = of.join(least, "component").select("fp", "least")
    out = rows.join(of, "fp")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.col("least.id").alias("component_id"), (F.col("uid") == F.col("least.uid")).alias("kept"), "uid")
