"""Search that visits the shards nearest to a query and reads product codes, not vectors.

A routed index is a folder of tables that a build writes once:

    walk      a row a shard: ids, product codes, neighbour lists, members and start points of labels;
              bucketed by shard
    full      (id, vec): the vectors, bucketed by id
    centres   (id, vec): the mean of each shard, and a tree over them that finds a query's shards

A search has three joins. Queries go to their nearest shards through the tree. Blocks of queries, all
that want a shard together, meet its row, which stays in its bucket, and walk its graph by codes. What they expand is
looked up in the vectors, each once a query, which stay in their buckets too, and measured in double. Queries are a table
throughout; only the codebook, of a fixed size, and the tree's first level reach the driver.
A shard that more than HOT blocks of queries want is dealt to several tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import check_metric, distance, normalised
from ..plans.tables import scratch, written
from ..sources import texts
from . import kernels, partition, pq, vamana
from .knn import ranked

#: Queries of one block, and blocks of one shard beyond which it is copied to more tasks.
BLOCK, HOT = 128, 64
#: Shards that a vector's code is kept in: a query that visits few shards finds more of its neighbours there.
COPIES = 3
#: Buckets of shards at most, as many as shards where they are fewer; vectors of one bucket about, and buckets of them at most.
SHARD_BUCKETS, VECTORS, VECTOR_BUCKETS = 8192, 200_000, 65_536
_WALK = (
    "shard int, ids array<bigint>, codes binary, nbrs binary, degree int, starts array<int>, "
    "labels array<bigint>, ends array<int>, members array<int>, label_starts array<int>"
)
_WALKED = "query_id bigint, ids array<bigint>, hops bigint, n_compared bigint, n_ios bigint"


def packed(index: DataFrame, book: pq.Codebook, metric: str = "l2", seed: int = 0) -> DataFrame:
    """A row a shard of what a walk reads, and the shard's centre, from an index of vamana.build()."""

    def pack(table: pa.Table) -> pa.Table:
        table, ids, full, lists, starts = vamana._local(table)
        nbrs = kernels.padded(lists, max((len(v) for v in lists), default=1)).astype(np.int32)
        codes = book.encode(vamana._ready(full, metric).astype(np.float64)).astype(np.uint8)
        members = kernels.members_of(table.column("labels").to_pylist())
        first = kernels.label_starts(members, len(ids), seed)
        names = sorted(members)
        row = {
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "codes": pa.array([codes.tobytes()], pa.binary()),
            "nbrs": pa.array([nbrs.tobytes()], pa.binary()),
            "degree": pa.array([nbrs.shape[1]], pa.int32()),
            "starts": pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
            "labels": pa.array([names], pa.list_(pa.int64())),
            "ends": pa.array([np.cumsum([len(members[v]) for v in names]).astype(np.int32)], pa.list_(pa.int32())),
            "members": pa.array([np.concatenate([members[v] for v in names] or [np.zeros(0)]).astype(np.int32)], pa.list_(pa.int32())),
            "label_starts": pa.array([np.array([first[v] for v in names], np.int32)], pa.list_(pa.int32())),
            "centre": pa.array([full.mean(0)], pa.list_(pa.float64())),
        }
        return pa.table(row)

    return index.groupBy("shard").applyInArrow(pack, _WALK + ", centre array<double>")


def _bucketed(df: DataFrame, path: str, by: str, n: int) -> None:
    """df as n buckets of files under path; who reads them by bucket needs no shuffle."""
    name = "t" + hashlib.sha256(path.encode()).hexdigest()[:24]
    df.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", path).mode("overwrite").saveAsTable(name)


def _opened(spark: SparkSession, path: str, schema: str, by: str, n: int) -> DataFrame:
    """The buckets under path as a table, whatever session wrote them."""
    name = "t" + hashlib.sha256(path.encode()).hexdigest()[:24]
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{where}'")
    return spark.table(name)


class RoutedIndex:
    """A graph index in shards; a search visits some of them. build() writes it, RoutedIndex(spark, path) opens it."""

    def __init__(self, spark: SparkSession, path: str):
        tables, self.meta = texts.load_tables(spark, path, ["cells", "parts", "codebook"])
        self.spark, self.path, self.metric = spark, path, self.meta["metric"]
        self.walk = _opened(spark, f"{path}/walk", _WALK, "shard", self.meta["shard_buckets"])
        self.full = _opened(spark, f"{path}/full", "id bigint, vec array<float>", "id", self.meta["vector_buckets"])
        cells = tables["cells"].orderBy("cell").collect()  # partition.CELLS rows at most
        self.tree = partition.Tree(np.array([r.centre for r in cells]), tables["parts"])
        rows = tables["codebook"].orderBy("chunk", "centre").collect()  # 256 centres a chunk at most
        centres = [np.array([r.vec for r in rows if r.chunk == i]) for i in range(len(self.meta["offsets"]) - 1)]
        self.book = pq.Codebook(centres, np.array(self.meta["offsets"]), np.array(self.meta["mean"]) if self.meta["mean"] is not None else None)

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str, metric: str = "l2", degree: int = 64, complexity: int = 100, alpha: float = 1.2,
        shard_size: int = vamana.SHARD, copies: int = COPIES, pq_chunks: int = 32, filtered: bool = False, seed: int = 0,
    ) -> RoutedIndex:
        """Builds from vectors(id, vec[, labels]) with labels as numbers into an empty folder and opens it.

        copies: shards that a vector's code and list are kept in; the vector itself is kept once.
        """
        with scratch(vectors.sparkSession):
            index = vamana.build(vectors, degree, complexity, alpha, metric, shard_size, copies, seed, filtered)
            return cls.pack(index, path, metric, pq_chunks, seed)

    @classmethod
    def pack(cls, index: DataFrame, path: str, metric: str = "l2", pq_chunks: int = 32, seed: int = 0) -> RoutedIndex:
        """Writes an index of vamana.build(), build_stitched(), insert() or consolidate() for routed search."""
        check_metric(metric)
        with scratch(index.sparkSession):
            cls._write(index, path, metric, pq_chunks, seed)
        return cls(index.sparkSession, path)

    @staticmethod
    def _write(index: DataFrame, path: str, metric: str, pq_chunks: int, seed: int) -> None:
        spark, index = index.sparkSession, written(index)
        once = index.where(~vamana.is_frozen(F.col("id"))).select("id", "vec").dropDuplicates(["id"])
        first = index.select(F.size("vec").alias("d")).first()
        if first is None:
            raise ValueError("there are no vectors")
        ready = once.withColumn("vec", normalised(F.col("vec"))) if metric == "cosine" else once
        book = pq.train(ready, min(pq_chunks, first.d), metric="ip" if metric == "ip" else "l2", seed=seed)
        rows = written(packed(index, book, metric, seed))
        n, shards = once.count(), rows.count()
        meta = {"metric": metric, "dims": first.d, "points": n, "shards": shards, "shard_buckets": min(shards, SHARD_BUCKETS), "vector_buckets": min(math.ceil(n / VECTORS), VECTOR_BUCKETS)}
        _bucketed(rows.drop("centre"), f"{path}/walk", "shard", meta["shard_buckets"])
        _bucketed(once, f"{path}/full", "id", meta["vector_buckets"])
        tree = partition.tree_of(rows.select(F.col("shard").cast("bigint").alias("id"), F.col("centre").alias("vec")), seed)
        cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(tree.cells)], "cell int, centre array<double>")
        codebook = spark.createDataFrame([(i, j, c.tolist()) for i, own in enumerate(book.centres) for j, c in enumerate(own)], "chunk int, centre int, vec array<double>")
        meta |= {"offsets": book.offsets.tolist(), "mean": book.mean.tolist() if book.mean is not None else None}
        texts.save_tables(path, {"cells": cells, "parts": tree.parts, "codebook": codebook}, meta)

    def route(self, queries: DataFrame, visit: int) -> DataFrame:
        """(query_id, shard) of the `visit` shards whose centres are nearest to each of queries(query_id, vec)."""
        near = partition.nearest_parts(queries.select(F.col("query_id").alias("id"), "vec"), self.tree, visit, partition.PROBE)
        return near.select(F.col("id").alias("query_id"), F.col("part").alias("shard"))

    def search(self, queries: DataFrame, k: int, complexity: int, visit: int, universal: int | None = None, tombstones: DataFrame | None = None, beam: int = 4, io_limit: int = 0) -> DataFrame:
        """(query_id, rank, id, distance, hops, n_compared, n_ios) of the k nearest found for queries(query_id, vec[, label]).

        visit: shards that a query goes to. With a label only points that have it, or the universal
        one, are walked and returned. n_ios: vectors that were read for the query.
        """
        if k <= 0 or complexity < k or visit <= 0:
            raise ValueError("k and the number of shards must be positive, complexity at least k")
        asked = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("bigint").alias("label") if "label" in queries.columns else F.lit(None).cast("bigint").alias("label"))
        blocks = self.route(asked, visit).join(asked, "query_id").select("shard", "query_id", "vec", "label")
        blocks = written(blocks.mapInArrow(_blocks, "shard int, query_ids array<bigint>, vecs array<double>, wanted array<bigint>"))
        found = written(self._met(blocks).mapInArrow(self._walker("label" in queries.columns, universal, complexity, beam, io_limit), _WALKED))
        # a query's candidates once each, one after another, so that its vector beside each takes little in the shuffle; the side of the vectors is hashed, as sorting the candidates would spill them all
        once = found.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        some = once.select("query_id", F.explode("ids").alias("id")).join(tombstones.select("id"), "id", "left_anti").groupBy("query_id").agg(F.collect_list("id").alias("ids")) if tombstones is not None else once
        some = some.join(asked.select("query_id", F.col("vec").alias("q")), "query_id").select("query_id", "q", F.explode("ids").alias("id"))
        best = some.repartition(self.meta["vector_buckets"], "id").join(self.full.hint("shuffle_hash"), "id").select("query_id", "id", distance(self.metric, F.col("vec"), F.col("q")).alias("distance"))
        stats = found.groupBy("query_id").agg(F.max("hops").alias("hops"), F.sum("n_compared").alias("n_compared"), F.sum("n_ios").alias("n_ios"))
        return ranked(best, k).join(stats, "query_id").select("query_id", "rank", "id", "distance", "hops", "n_compared", "n_ios")

    def _met(self, blocks: DataFrame) -> DataFrame:
        """The blocks of queries of each shard, put together, with the row of the shard: once, whatever the number of queries.

        Rows of shards move only where more than HOT blocks want one; each copy of it then gets some HOT of them.
        """
        copies = F.ceil(F.col("count") / HOT).cast("int")
        hot = written(blocks.groupBy("shard").count().where(F.col("count") > HOT).select("shard", copies.alias("copies")))
        beside = lambda b: _together(b.repartition(self.meta["shard_buckets"], "shard"), "shard").join(self.walk, "shard")  # noqa: E731  as the buckets lie
        if hot.isEmpty():
            return beside(blocks)
        cold = beside(blocks.join(hot, "shard", "left_anti"))
        dealt = blocks.join(hot, "shard").withColumn("copy", F.pmod(F.xxhash64("query_ids"), F.col("copies")).cast("int")).drop("copies")
        rows = self.walk.join(hot, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        return cold.unionByName(_together(dealt, "shard", "copy").join(rows, ["shard", "copy"]).drop("copy"))

    def _walker(self, label: bool, universal: int | None, width: int, beam: int, io_limit: int):
        book, metric, dims = self.book, self.metric, self.meta["dims"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i] for name in batch.schema.names}
                    n = len(row["query_ids"].values)
                    for a in range(0, n, BLOCK):
                        m = min(BLOCK, n - a)
                        yield walk(row, row["query_ids"].values.slice(a, m), row["vecs"].values.slice(a * dims, m * dims), row["wanted"].values.slice(a, m))

        def walk(row, query_ids: pa.Array, vecs: pa.Array, wanted: pa.Array) -> pa.RecordBatch:
            array = lambda name: row[name].values.to_numpy(zero_copy_only=False)
            ids = array("ids")
            codes = np.frombuffer(row["codes"].as_buffer(), np.uint8).reshape(len(ids), -1)
            nbrs = np.frombuffer(row["nbrs"].as_buffer(), np.int32).reshape(len(ids), -1)
            own = vamana._ready(vecs.to_numpy(zero_copy_only=False).reshape(-1, dims), metric).astype(np.float64)
            tables = np.zeros((codes.shape[1], len(own), pq.CENTRES))
            for c, t in enumerate(book.tables(own, "ip" if metric == "ip" else "l2")):
                tables[c, :, : t.shape[1]] = t
            chunk = np.arange(codes.shape[1])
            seen: dict = {}
            if label:
                names, ends, members, firsts = (array(n) for n in ("labels", "ends", "members", "label_starts"))

            def entry(v):
                """(allowed points, starts) of a label: read once a block, from what the index stores."""
                if v not in seen:
                    allowed, starts = np.zeros(len(ids), bool), []
                    for name in {v, universal if universal is not None else v}:
                        at = int(np.searchsorted(names, name))
                        if at < len(names) and names[at] == name:
                            allowed[members[ends[at - 1] if at else 0 : ends[at]]] = True
                            starts.append(firsts[at])
                    seen[v] = allowed, np.array(starts, np.int64)
                return seen[v]

            out = []
            for q, v in enumerate(wanted.to_pylist()):
                allowed, starts = entry(v) if label and v is not None else (None, array("starts"))
                measure = lambda near, t=tables[:, q]: t[chunk, codes[near]].sum(1)
                _, _, expanded, hops, compared = kernels.greedy_search(own[q], codes, nbrs, starts, width, metric, allowed, measure, beam, io_limit)
                expanded = expanded[~vamana.is_frozen(ids[expanded])]
                out.append((ids[expanded], hops, compared, len(expanded)))
            columns = [query_ids, pa.array([o[0] for o in out], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns + [pa.array([o[j] for o in out], pa.int64()) for j in (1, 2, 3)], ["query_id", "ids", "hops", "n_compared", "n_ios"])

        return run


def _together(blocks: DataFrame, *by: str) -> DataFrame:
    """The blocks of queries with the same keys as one row."""
    every = blocks.groupBy(*by).agg(F.collect_list(F.struct("query_ids", "vecs", "wanted")).alias("every"))
    return every.select(*by, *[F.flatten(F.col(f"every.{c}")).alias(c) for c in ("query_ids", "vecs", "wanted")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (shard, query_id, vec, label) as rows of up to BLOCK queries of one shard, packed where they are."""
    names = ["shard", "query_ids", "vecs", "wanted"]

    def emit(shard: int, rows: list) -> pa.RecordBatch:
        ids, vecs, wanted = (pa.concat_arrays([r[i] for r in rows]) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(vecs)], vecs), pa.ListArray.from_arrays([0, len(wanted)], wanted)], names
        )

    waiting: dict[int, list] = {}
    held = 0
    for batch in batches:
        shards = batch.column(0).to_numpy()
        order = np.argsort(shards, kind="stable")
        own, first = np.unique(shards[order], return_index=True)
        for shard, at in zip(own.tolist(), np.split(order, first[1:])):
            for a in range(0, len(at), BLOCK):
                some = batch.take(pa.array(at[a : a + BLOCK]))
                waiting.setdefault(shard, []).append((some.column(1), some.column(2).flatten(), some.column(3)))
                if sum(len(r[0]) for r in waiting[shard]) >= BLOCK:
                    yield emit(shard, waiting.pop(shard))
        held += len(shards)
        if held > 100_000:
            for shard in sorted(waiting):
                yield emit(shard, waiting[shard])
            waiting, held = {}, 0
    for shard in sorted(waiting):
        yield emit(shard, waiting[shard])
