"""Index classes over folders of tables: in memory, on disk, and the dynamic one.

StaticIndex is a graph index; DiskIndex keeps product codes and lists in a row a shard and the vectors
beside them, so a search reads codes, visits the shards it is told to and looks up only the vectors of
expanded nodes. Both are a folder with the table "index" and one line of meta (dtype, metric, points,
dims, degree, ...), which open() reads, so dtype and metric need not be given again. RoutedIndex is the
part of a DiskIndex that a search reads, for labels that are numbers already.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import check_metric, converted
from .operators import labels as label_ops
from .operators import pq, vamana
from .operators.routed import RoutedIndex
from .plans.tables import scratch
from .sources import texts
from .streaming.dynamic import DynamicIndex

__all__ = ["StaticIndex", "DiskIndex", "DynamicIndex", "RoutedIndex"]


class StaticIndex:
    """A built index; search answers a table of queries, search_one a single vector."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        tables, self.meta = texts.load_tables(spark, path, ["index"])
        self.table = tables["index"]
        self.labels = spark.read.parquet(f"{path}/label_dict") if self.meta.get("labels") else None

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str, metric: str = "l2", dtype: str = "float", degree: int = 64, complexity: int = 100, alpha: float = 1.2,
        filter_complexity: int = 0, universal_label: str | None = None, stitched_degree: int | None = None, shard_size: int = vamana.SHARD,
    ):
        """Builds from vectors(id, vec[, labels]) into a folder and opens it.

        labels are strings; with filter_complexity above 0 they become a graph stitched from one graph
        for each label, otherwise they only filter the search.
        """
        check_metric(metric, dtype)
        vamana.check_build(degree, complexity, alpha)
        with scratch(vectors.sparkSession):
            cls._write(vectors, path, metric, dtype, degree, complexity, alpha, filter_complexity, universal_label, stitched_degree, shard_size)
        return cls(vectors.sparkSession, path)

    @classmethod
    def _write(cls, vectors, path, metric, dtype, degree, complexity, alpha, filter_complexity, universal_label, stitched_degree, shard_size) -> None:
        spark, meta = vectors.sparkSession, {}
        vectors = vectors.withColumn("vec", converted(F.col("vec"), dtype))
        first = vectors.select(F.size("vec").alias("d")).first()
        if first is None:
            raise ValueError("there are no vectors")
        if "labels" in vectors.columns:
            coded, table = label_ops.encode(vectors.select("id", "labels"), universal_label)
            table.write.mode("overwrite").parquet(f"{path}/label_dict")
            vectors = vectors.drop("labels").join(coded, "id", "left").withColumn("labels", F.coalesce("labels", F.expr("cast(array() as array<bigint>)")))
            meta |= {"labels": True, "universal": 0 if universal_label is not None else None}
        if filter_complexity > 0 and "labels" in vectors.columns:
            index = vamana.build_stitched(vectors, degree, filter_complexity, alpha, metric, stitched_degree)
        else:
            index = vamana.build(vectors, degree, complexity, alpha, metric, shard_size)
        meta |= {"dtype": dtype, "metric": metric, "points": vectors.count(), "dims": first.d, "degree": degree, "alpha": alpha, **cls._more(vectors, metric, path)}
        texts.save_tables(path, {"index": index}, meta)
        cls._beside(texts.load_tables(spark, path, ["index"])[0]["index"], metric, path)

    @classmethod
    def _beside(cls, index: DataFrame, metric: str, path: str) -> None:
        """Writes what a kind of index has beside the table "index"."""

    @classmethod
    def _more(cls, vectors: DataFrame, metric: str, path: str) -> dict:
        return {}

    def _options(self) -> dict:
        return {}

    def search(self, queries: DataFrame, k: int, complexity: int, filter_label: str | None = None, **options) -> DataFrame:
        """(query_id, rank, id, distance, ...) for queries(query_id, vec); fewer than k rows if a label has fewer points."""
        if k <= 0 or complexity <= 0:
            raise ValueError("k and complexity must be positive")
        if complexity < k:
            warnings.warn(f"complexity {complexity} is raised to k = {k}", stacklevel=2)
            complexity = k
        if filter_label is not None:
            if self.labels is None:
                raise ValueError("this index has no labels")
            row = self.labels.where(F.col("label") == filter_label).first()
            if row is None:
                raise ValueError(f"unknown label {filter_label!r}")
            queries = queries.withColumn("label", F.lit(row.label_id))
        return self._found(queries, k, complexity, **options)

    def _found(self, queries: DataFrame, k: int, complexity: int, **options) -> DataFrame:
        return vamana.search(self.table, queries, k, complexity, self.meta["metric"], self.meta.get("universal"), **options)

    def search_one(self, query, k: int, complexity: int, filter_label: str | None = None) -> tuple[list[int], list[float]]:
        """(ids, distances) of one vector."""
        if len(query) != self.meta["dims"]:
            raise ValueError(f"the index has {self.meta['dims']} dimensions, the query {len(query)}")
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, vec array<double>")
        rows = self.search(one, k, complexity, filter_label).orderBy("rank").collect()
        return [r.id for r in rows], [r.distance for r in rows]

    def range_search(self, queries: DataFrame, radius: float, complexity: int = 16, **options) -> DataFrame:
        return vamana.search(self.table, queries, 1, complexity, self.meta["metric"], self.meta.get("universal"), radius=radius, **self._options(), **options)


class DiskIndex(StaticIndex):
    """An index whose search is guided by stored product codes of `pq_chunks` bytes.

    search(..., visit=m) goes to the m nearest shards of each query; without it, to all.
    """

    pq_chunks: int = 32

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.routed = RoutedIndex(spark, f"{path}/routed")

    @classmethod
    def _beside(cls, index: DataFrame, metric: str, path: str) -> None:
        RoutedIndex.pack(index, f"{path}/routed", metric, cls.pq_chunks)

    def _found(self, queries: DataFrame, k: int, complexity: int, visit: int | None = None, **options) -> DataFrame:
        return self.routed.search(queries, k, complexity, visit or self.routed.meta["shards"], self.meta.get("universal"), **options)

    @classmethod
    def _more(cls, vectors: DataFrame, metric: str, path: str) -> dict:
        dims = vectors.select(F.size("vec").alias("d")).first().d
        book = pq.train(vectors, min(cls.pq_chunks, dims), metric="ip" if metric == "ip" else "l2")
        rows = [(i, j, c.tolist()) for i, centres in enumerate(book.centres) for j, c in enumerate(centres)]
        vectors.sparkSession.createDataFrame(rows, "chunk int, centre int, vec array<double>").write.mode("overwrite").parquet(f"{path}/codebook")
        return {"offsets": book.offsets.tolist(), "mean": book.mean.tolist() if book.mean is not None else None}

    def _options(self) -> dict:
        return {"book": self.codebook(), "beam": 2}

    def codebook(self) -> pq.Codebook:
        rows = sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/codebook").collect())  # 256 centres a chunk at most
        n = len(self.meta["offsets"]) - 1
        centres = [np.array([v for c, _, v in rows if c == i]) for i in range(n)]
        return pq.Codebook(centres, np.array(self.meta["offsets"]), np.array(self.meta["mean"]) if self.meta["mean"] is not None else None)


def answer_json(index: StaticIndex, lines: DataFrame) -> DataFrame:
    """JSON answers to JSON queries (a batch): each k and list width, with or without labels, is served by its own search.

    A label that the index does not know gets an error for an answer.
    """
    good, bad = texts.parse_queries(lines)
    names = index.labels.select("label", "label_id") if index.labels is not None else lines.sparkSession.createDataFrame([], "label string, label_id bigint")
    good = good.join(F.broadcast(names), "label", "left")  # a row a label of the index
    lost = good.where("label is not null and label_id is null").select("query_id", F.concat(F.lit("unknown label "), "label").alias("error"))
    good, bad = good.where("label is null or label_id is not null"), bad.select("query_id", "error").unionByName(lost)
    out = None
    for r in good.select("k", "width", F.col("label").isNotNull().alias("named")).distinct().toLocalIterator():
        same = good.where((F.col("k") == r.k) & (F.col("width") == r.width) & (F.col("label").isNotNull() == r.named))
        found = index.search(same.select("query_id", "vec", *([F.col("label_id").alias("label")] if r.named else [])), r.k, r.width)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return bad.select(F.to_json(F.struct("query_id", "error")).alias("value"))
    return texts.answers_json(out.select("query_id", "rank", "id", "distance"), bad)
