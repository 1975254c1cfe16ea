"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Dividing it by the source's words gives the expected
copies of each of its documents. Copies that are certain are allocated first: the whole part of what
is expected. What the target still lacks is a sample with unequal inclusion probabilities: documents
are alike, but one that alone makes more than UPSET of what is lacking is less likely, as a single
copy of it would upset the target. The odds are p / (1 - p) = c * min(1, UPSET * lack / size), and the
source's one number c is solved for, so that the words times p of all its documents add up to what is
lacking: p is the probability of inclusion, and where no document is that large it is the same for
all. Documents are ranked by the odds of a random number over the inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken in that order until the sample has its fixed size, the words
that are lacking. The random number is a hash of the document id, so reruns agree.

c comes from the words of the source's documents by size, in classes of 1/64 of a power of two (some
2,000 rows a source whatever its size); the size that enters the odds is the least of its class.

The order within a source is never sorted in one task: words are summed by source and rank bucket,
which names the one bucket that a source's cut falls in, and only that bucket's rows are sorted.

Nulls: a null source is a source of its own, last in order; null or empty texts have size 0, are
never sampled (taken is 0) but are returned. Repeated rows count each. Ties in rank are cut by id,
size. An empty table gives an empty result. Extra columns may have any names; a text of any length is
one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, numbered, parts_for, slices, words, written

#: Sources up to which the table of sources (one short row each) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 10_000
#: Share of a source's lacking words from which on a document is less likely to be sampled.
UPSET = 0.01


def word_counts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, more..., size): words of each text; a null text has none."""
    keep = [id_col, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(batch.num_columns - 1))
            sizes = np.zeros(batch.num_rows, np.int64)
            for a, b in slices(offsets):
                _, _, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sizes[a:b] = np.diff(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], [*names, "size"])

    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    return rows.mapInArrow(run, f"{schema}, size bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): by weight, none above `most` times its source's size.

    The excess is reshared by weight until none is above: sources in order of limit over weight are
    at their limit as long as an even share of what is left would exceed it. One row a source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_limit = everything.orderBy("reach", F.col("source").asc_nulls_last())
    past = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", each).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    x = x.withColumn("reach", F.col("limit") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(past), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(past), F.lit(0.0))
    x = x.withColumn("level", left / open_)
    # once one source is below its limit so are all after it, at the level of the first of them
    x = x.withColumn("level", F.max(F.when(F.col("reach") > F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull() | (F.col("reach") <= F.col("level")), F.col("limit")).otherwise(F.col("level") * F.col("weight"))
    return x.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def size_class(size: Column) -> Column:
    """The least size of the class: sizes below 128 stand alone, larger ones by their seven leading bits."""
    low = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    step = F.pow(F.lit(2.0), low).cast("bigint")
    return size - size % step


def scales(classes: DataFrame) -> DataFrame:
    """(source, scale) of classes(source, least, words, lack): the number c of each source."""

    def solve(table: pa.Table) -> pa.Table:
        lack = table.column("lack")[0].as_py()
        words_, least = (np.array(table.column(n).to_pylist(), np.float64) for n in ("words", "least"))
        order = np.argsort(least)  # sums do not depend on the order of arrival
        words_, w = words_[order], np.minimum(1, UPSET * lack / least[order])
        low, high = -60.0, 60.0
        for _ in range(120 if lack > 0 else 0):  # words grow with c; halve its logarithm's range
            mid = (low + high) / 2
            odds = np.exp(mid) * w
            low, high = (mid, high) if (words_ * (odds / (1 + odds))).sum() < lack else (low, mid)
        return pa.table([table.column("source")[:1], pa.array([float(np.exp((low + high) / 2)) if lack > 0 else 0.0])], names=["source", "scale"])

    return classes.groupBy("source").applyInArrow(solve, f"source {classes.schema['source'].dataType.simpleString()}, scale double")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8, uid: Column | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, p, uid) of every row.

    p: the probability that a copy beyond the certain ones is taken.
    weights: of the sources in order of their names by code point, repeating; share: words of the
    mix over words of the corpus; most: copies that no document exceeds; uid: what numbers the rows
    of docs; whoever joins the result with docs gives a column of a written table (common.numbered).
    """
    rows = docs.select(id_col, source_col, text_col, (F.monotonically_increasing_id() if uid is None else uid).alias("uid"))
    base = written(word_counts(rows, id_col, text_col, source_col, "uid").toDF("id", "source", "uid", "size"))
    buckets = 256 * parts_for(base, 1 << 23)
    table = written(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    table = table.withColumn("whole", F.floor(expected).cast("bigint"))
    table = table.withColumn("lack", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    small = table.count() <= BROADCAST_SOURCES

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "its")
        return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("its")), "left").drop("its")

    classes = base.where("size > 0").groupBy("source", size_class(F.col("size")).alias("least")).agg(F.sum("size").alias("words"))
    solved = written(scales(with_source(classes, table.select("source", "lack"))))
    table = with_source(table, solved)
    u = uniform(F.col("id"), seed)
    odds = F.col("scale") * F.least(F.lit(1.0), UPSET * F.col("lack") / size_class(F.col("size")))
    sampled = (F.col("scale") > 0) & (F.col("size") > 0)
    ranked = with_source(base, table).withColumn("odds", F.when(sampled, odds)).withColumn("p", F.when(sampled, F.col("odds") / (1 + F.col("odds"))).otherwise(0.0))
    ranked = ranked.withColumn("rank", F.when(F.col("odds") > 0, (u / (1 - u)) / F.col("odds"))).drop("odds", "scale")
    ranked = ranked.withColumn("bucket", F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * buckets), F.lit(buckets - 1))))

    sums = ranked.where("rank is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("lack").alias("lack"))
    in_order = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(in_order))
    # the first bucket whose words reach what is lacking
    cuts = sums.where("upto >= lack").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("base"))).alias("cut"))
    cuts = written(cuts.select("source", F.col("cut.bucket").alias("cut"), F.col("cut.base").alias("base")))

    x = with_source(ranked, cuts)
    middle = x.where("bucket = cut")
    within = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = middle.withColumn("more", (F.col("base") + F.sum("size").over(within) - F.col("size") / 2 <= F.col("lack")).cast("bigint"))
    # without a cut, all sampled rows fit
    rest = x.where("not (bucket <=> cut and bucket is not null)").withColumn("more", F.coalesce((F.col("bucket") < F.coalesce("cut", F.lit(buckets))).cast("bigint"), F.lit(0)))
    out = middle.unionByName(rest).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0)).cast("bigint"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "p", "uid")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of docs as often as mix() says, all its columns unchanged."""
    uid = "uid"
    while uid in docs.columns:  # a name that the table does not have
        uid += "_"
    rows = numbered(docs, uid)
    counts = mix(rows, id_col=id_col, text_col=text_col, source_col=source_col, uid=F.col(uid), **options).where("copies > 0")
    counts = counts.select(F.col("uid").alias(uid), F.sequence(F.lit(1).cast("bigint"), F.col("copies")).alias(uid + "copies"))
    return rows.join(counts, uid).withColumn(uid + "copies", F.explode(uid + "copies")).select(*docs.columns)
