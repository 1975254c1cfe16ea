"""The registered queries of the engine and the DuckDB SQL for the same rows.

Inputs are derived from the table embeddings by rules that Spark and SQL state alike: vectors
scaled by 1 + id % 7 (so that metrics rank differently), quantised vectors, label lists, the exact
8-nearest-neighbour graph, and an access profile with counts made from node numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as fv
from .operators import disk, graph, knn, labels, maintenance, metrics, pq, profile
from .plans import layouts
from .plans.tables import shared_folder, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CAP, BUDGET = 5, 600


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def scaled(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x.cast("double") * (1 + F.col("id") % 7)))


def int8s(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * 100).cast("tinyint")))


def uint8s(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: (F.floor(x.cast("double") * 100) + 128).cast("smallint")))


def labelled(spark, sf_dir) -> DataFrame:
    own = F.array(F.col("label").cast("bigint"), 10 + F.col("id") % 3)
    return scaled(spark, sf_dir).withColumn("labels", F.when(F.col("id") % 50 == 0, F.concat(own, F.array(F.lit(99).cast("bigint")))).otherwise(own))


def asked(base: DataFrame, *more) -> DataFrame:
    """The queries of searches: every row whose id is divisible by 100."""
    return base.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec", *more)


def edges(spark, sf_dir) -> DataFrame:
    """The exact graph, written once for all that a query derives from it."""
    return written(knn.nearest_others(embeddings(spark, sf_dir), 8).select(F.col("query_id").alias("src"), F.col("id").alias("dst")))


def edge_profile(spark, sf_dir, e: DataFrame | None = None) -> DataFrame:
    """The profile of the graph, or of the one that a query has made already."""
    return (edges(spark, sf_dir) if e is None else e).select(F.col("src").alias("u"), F.col("dst").alias("v"), (1 + (F.col("src") * 31 + F.col("dst") * 17) % 23).alias("cnt"))


def node_profile(spark, sf_dir, ep: DataFrame) -> DataFrame:
    x = embeddings(spark, sf_dir).select("id").join(profile.in_heat(ep).withColumnRenamed("heat", "n_expand"), "id", "left").join(profile.out_heat(ep).withColumnRenamed("heat", "out_heat"), "id", "left")
    return x.select("id", F.coalesce("n_expand", F.lit(0)).alias("n_expand"), F.coalesce("out_heat", F.lit(0)).alias("out_heat"))


def trace(spark, sf_dir, e: DataFrame | None = None) -> DataFrame:
    e = (edges(spark, sf_dir) if e is None else e).select((F.col("src") % 10).alias("query_id"), (F.col("dst") % 4).alias("hop"), F.col("dst").alias("node_id"), F.col("src").alias("parent_id"))
    return e.withColumn("event", F.lit("visit")).unionByName(e.where("(node_id + parent_id) % 3 = 0").withColumn("event", F.lit("expand")))


def reads(spark, sf_dir) -> DataFrame:
    """Sectors that queries over the graph read, eight queries for every 40 nodes: nodes in order, five to a sector."""
    return edges(spark, sf_dir).select((F.floor(F.col("src") / 40) * 8 + F.col("src") % 8).alias("query_id"), (F.col("src") * (1 << 31) + F.col("dst")).alias("seq"), F.floor(F.col("dst") / CAP).alias("sector"))


# ---------------------------------------------------------------- the same in SQL


def _sum(term: str, a: str = "a") -> str:
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {term}), lambda s, t: s + t)"


_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings)"
_S = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS vec, label, CASE WHEN vec_id % 50 = 0 THEN [label::BIGINT, 10 + vec_id % 3, 99] ELSE [label::BIGINT, 10 + vec_id % 3] END AS labels FROM embeddings)"
_I8 = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)) AS vec, label FROM embeddings)"
_U8 = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100) + 128) AS vec, label FROM embeddings)"
_L2 = _sum("(b.vec[i] - q.vec[i]) * (b.vec[i] - q.vec[i])", "q.vec")
_DOT = _sum("b.vec[i] * q.vec[i]", "q.vec")
_BB, _QQ = _sum("b.vec[i] * b.vec[i]", "b.vec"), _sum("q.vec[i] * q.vec[i]", "q.vec")
_DISTANCE = {"l2": _L2, "ip": f"-{_DOT}", "cosine": f"1 - {_DOT} / (sqrt({_BB}) * sqrt({_QQ}))", "fast_l2": f"{_BB} - 2 * {_DOT}"}


def _knn(source: str, metric: str = "l2", k: int = 10, where: str = "true", more: str = "") -> str:
    return f"""WITH {source}, d AS (SELECT q.id AS query_id, b.id AS id, {_DISTANCE[metric]} AS distance FROM v q, v b WHERE q.id % 100 = 0 AND {where}),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d)
        SELECT query_id, rank, id, distance{more} FROM r WHERE rank <= {k}"""


_E = f"""{_V}, ed AS (SELECT q.id AS src, b.id AS dst, {_L2} AS distance FROM v q, v b WHERE q.id <> b.id),
    e AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rn FROM ed) WHERE rn <= 8)"""
_EP = f"{_E}, ep AS MATERIALIZED (SELECT src AS u, dst AS v, 1 + (src * 31 + dst * 17) % 23 AS cnt FROM e)"
_NP = f"""{_EP}, np AS MATERIALIZED (SELECT v.id, coalesce(i.h, 0)::BIGINT AS n_expand, coalesce(o.h, 0)::BIGINT AS out_heat FROM v
    LEFT JOIN (SELECT v, sum(cnt) AS h FROM ep GROUP BY v) i ON i.v = v.id LEFT JOIN (SELECT u, sum(cnt) AS h FROM ep GROUP BY u) o ON o.u = v.id)"""
_CH = """ch AS MATERIALIZED (SELECT u, v, cnt, row_number() OVER (PARTITION BY u ORDER BY cnt DESC, v) AS rn, sum(cnt) OVER (PARTITION BY u) AS total,
    sum(cnt) OVER (PARTITION BY u ORDER BY cnt DESC, v) AS running, count(*) OVER (PARTITION BY u) AS n_children FROM ep)"""


def _threshold(share: float) -> str:
    return f"""k0 AS (SELECT u, min(rn) FILTER (WHERE running::DOUBLE / total >= {share}) AS k0 FROM ch GROUP BY u),
    th AS MATERIALIZED (SELECT ch.*, least(n_children, CASE WHEN k0 <= {CAP - 1} THEN {CAP - 1} ELSE {CAP - 1} + ceil((k0 - {CAP - 1})::DOUBLE / {CAP})::BIGINT * {CAP} END)::BIGINT AS k FROM ch JOIN k0 USING (u))"""


_TRACE = f"""{_E}, t AS (SELECT src % 10 AS query_id, dst % 4 AS hop, dst AS node_id, src AS parent_id, 'visit' AS event FROM e
    UNION ALL SELECT src % 10, dst % 4, dst, src, 'expand' FROM e WHERE (src + dst) % 3 = 0)"""
_READS = f"{_E}, reads AS (SELECT src // 40 * 8 + src % 8 AS query_id, src * 2147483648 + dst AS seq, floor(dst / {CAP})::BIGINT AS sector FROM e)"
_PAGE = f"CASE WHEN rn <= {CAP - 1} THEN 0 ELSE 1 + floor((rn - {CAP}) / {CAP}) END::BIGINT"


# ---------------------------------------------------------------- A: exact search


def _exact(name: str, source, sql_source: str, metric: str) -> None:
    def run(spark, sf_dir):
        base = source(spark, sf_dir)
        return knn.exact(base, asked(base), 10, metric)

    run.__name__ = name
    query(_knn(sql_source, metric))(run)


for _name, _source, _sql, _metric in (
    ("knn_l2_top10", scaled, _S, "l2"), ("knn_ip_top10", scaled, _S, "ip"), ("knn_cosine_top10", scaled, _S, "cosine"), ("knn_fastl2_top10", scaled, _S, "fast_l2"),
    ("knn_int8_l2", int8s, _I8, "l2"), ("knn_uint8_cosine", uint8s, _U8, "cosine"), ("knn_int8_cosine", int8s, _I8, "cosine"), ("knn_uint8_l2", uint8s, _U8, "l2"),
):
    _exact(_name, _source, _sql, _metric)


@query(_knn(_S, "l2", where="list_contains(b.labels, 3)"))
def knn_filtered_label(spark, sf_dir):
    base = labelled(spark, sf_dir)
    return knn.exact(knn.filtered(base, 3), asked(base), 10)


@query(_knn(_S, "cosine", where="(list_contains(b.labels, 3) OR list_contains(b.labels, 99))"))
def knn_filtered_universal(spark, sf_dir):
    base = labelled(spark, sf_dir)
    return knn.exact(knn.filtered(base, 3, 99), asked(base), 10, "cosine")


@query(_knn(_S, "l2", where="list_contains(b.labels, q.label::BIGINT)"))
def knn_per_query_label(spark, sf_dir):
    base = labelled(spark, sf_dir)
    return knn.exact_with_label(base, asked(base, F.col("label").cast("bigint").alias("label")), 10)


@query(_knn(_S, "l2", where="(list_contains(b.labels, q.label::BIGINT) OR list_contains(b.labels, 99))"))
def knn_per_query_label_universal(spark, sf_dir):
    base = labelled(spark, sf_dir)
    return knn.exact_with_label(base, asked(base, F.col("label").cast("bigint").alias("label")), 10, universal=99)


@query(_knn(_S, "l2", where="b.id % 11 <> 0"))
def knn_active_tags(spark, sf_dir):
    base = scaled(spark, sf_dir)
    return knn.exact(knn.without_tombstones(base, base.where("id % 11 = 0")), asked(base), 10)


@query(f"""WITH {_S}, d AS (SELECT q.id AS query_id, b.id AS id, b.id % 3 AS partition, {_L2} AS distance FROM v q, v b WHERE q.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, partition ORDER BY distance, id) AS rn FROM d),
    m AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, partition, rn) AS rank, id, distance, partition FROM r WHERE rn <= 10)
    SELECT * FROM m WHERE rank <= 10""")
def knn_multi_index_merge(spark, sf_dir):
    base = scaled(spark, sf_dir)
    return knn.merge_results([knn.exact(base.where(F.col("id") % 3 == p), asked(base), 10) for p in range(3)], 10)


@query(f"""WITH {_S}, c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)) AS vec FROM embeddings),
    d AS (SELECT q.id AS query_id, b.id AS id, {_L2} AS distance FROM c q, c b WHERE q.id % 100 = 0),
    f AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM d) WHERE rn <= 30),
    g AS (SELECT f.query_id, f.id, {_L2} AS distance FROM f JOIN v b ON b.id = f.id JOIN v q ON q.id = f.query_id),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM g)
    SELECT * FROM r WHERE rank <= 10""")
def knn_rerank_3k(spark, sf_dir):
    base, coarse = scaled(spark, sf_dir), int8s(spark, sf_dir)
    first = knn.exact(coarse, asked(coarse), 30).select("query_id", "id", "distance")
    return knn.rerank(first, base, asked(base), 10, fv.l2_squared(F.col("vec"), F.col("query_vec")))


@query(f"WITH {_S}, d AS (SELECT q.id AS query_id, b.id AS id, {_L2} AS distance FROM v q, v b WHERE q.id % 100 = 0) SELECT * FROM d WHERE distance <= 6.0")
def range_search_exact(spark, sf_dir):
    base = scaled(spark, sf_dir)
    return knn.in_range(base, asked(base), 6.0)


@query(_knn(_S, "l2", 30) + " AND distance <= 6.0")
def range_truth_cut(spark, sf_dir):
    base = scaled(spark, sf_dir)
    return knn.cut_truth(knn.exact(base, asked(base), 30), 6.0)


@query(f"""WITH {_S}, d AS (SELECT q.id AS query_id, b.id AS id, {_L2} AS distance FROM v q, v b WHERE q.id % 100 = 0),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d)
    SELECT query_id, rank, CASE WHEN id % 4 = 1 THEN id - 1 ELSE id END AS id, distance FROM r WHERE rank <= 10""")
def knn_dummy_to_real(spark, sf_dir):
    base = scaled(spark, sf_dir)
    dummies = base.where("id % 4 = 1").select(F.col("id").alias("dummy_id"), (F.col("id") - 1).alias("real_id"))
    return knn.real_ids(knn.exact(base, asked(base), 10), dummies).select("query_id", "rank", "id", "distance")


# ---------------------------------------------------------------- F: vectors, recall, labels


@query(f"WITH {_S} SELECT v.id, p.i - 1 AS pos, round(v.vec[p.i] / sqrt({_sum('v.vec[i] * v.vec[i]', 'v.vec')}), 12) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) p")
def normalize_vectors(spark, sf_dir):
    x = fv.normalise(scaled(spark, sf_dir)).select("id", F.posexplode("vec").alias("pos", "x"))
    return x.select("id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 12).alias("x"))


@query(f"""WITH {_S}, m AS (SELECT max(sqrt({_sum('v.vec[i] * v.vec[i]', 'v.vec')})) AS max_norm FROM v), s AS (SELECT id, max_norm, list_transform(vec, lambda x: x / max_norm) AS vec FROM v, m)
    SELECT id, round(max_norm, 9) AS max_norm, round(sqrt(greatest(0.0, 1 - {_sum('vec[i] * vec[i]', 'vec')})), 6) AS last, len(vec) + 1 AS dim FROM s""")
def mips_augment(spark, sf_dir):
    x = fv.mips_augment(scaled(spark, sf_dir))
    return x.select("id", F.round("max_norm", 9).alias("max_norm"), F.round(F.element_at("vec", -1), 6).alias("last"), F.size("vec").cast("bigint").alias("dim"))


@query("SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x: trunc((x::DOUBLE - 0.1) * 254 / 2.5)::BIGINT))::BIGINT AS total, trunc((embedding[1]::DOUBLE - 0.1) * 254 / 2.5)::TINYINT AS first FROM embeddings")
def quantize_int8(spark, sf_dir):
    x = embeddings(spark, sf_dir).select("id", fv.quantise_int8(F.col("vec"), 0.1, 2.5).alias("q"))
    return x.select("id", F.aggregate("q", F.lit(0).cast("bigint"), lambda s, y: s + y.cast("bigint")).alias("total"), F.element_at("q", 1).alias("first"))


@query("SELECT vec_id AS id, 64::BIGINT AS dim, 0.0::DOUBLE AS last, 61::BIGINT AS cut FROM embeddings")
def pad_dims(spark, sf_dir):
    x = embeddings(spark, sf_dir).select("id", fv.padded(F.slice(fv.doubles(F.col("vec")), 1, 61)).alias("p"))
    return x.select("id", F.size("p").cast("bigint").alias("dim"), F.element_at("p", -1).alias("last"), F.size(fv.unpadded(F.col("p"), 61)).cast("bigint").alias("cut"))


@query(f"""WITH {_S}, n AS (SELECT sqrt({_sum('vec[i] * vec[i]', 'vec')}) AS norm FROM v), r AS (SELECT norm, row_number() OVER (ORDER BY norm) - 1 AS at_, count(*) OVER () AS n FROM n)
    SELECT s.share, r.norm AS value FROM r, (SELECT unnest(range(0, 21)) * 5 / 100.0::DOUBLE AS share) s WHERE r.at_ = least(floor(s.share * n), n - 1)""")
def vector_norm_percentiles(spark, sf_dir):
    return metrics.norm_percentiles(scaled(spark, sf_dir))


@query(f"WITH {_S} SELECT p.i - 1 AS pos, round(avg(v.vec[p.i]), 9) AS value FROM v, (SELECT unnest(range(1, 65)) AS i) p GROUP BY p.i")
def centroid(spark, sf_dir):
    return graph.centroid(scaled(spark, sf_dir)).select("pos", F.round("value", 9).alias("value"))


@query(f"""WITH {_S}, c AS (SELECT list(x ORDER BY i) AS vec FROM (SELECT p.i, avg(v.vec[p.i]) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) p GROUP BY p.i)),
    d AS (SELECT b.id, {_L2} AS distance FROM v b, c q) SELECT id, round(distance, 9) AS distance FROM d ORDER BY d.distance, id LIMIT 1""")
def medoid(spark, sf_dir):
    return graph.medoid(scaled(spark, sf_dir)).select("id", F.round("distance", 9).alias("distance"))


@query(f"""WITH {_S}, d AS (SELECT b.id AS id, q.id AS centre, {_L2} AS distance FROM v b, v q WHERE q.id < 4),
    r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY distance, centre) AS rank, centre, distance FROM d) SELECT * FROM r WHERE rank <= 2""")
def assign_top2_centers(spark, sf_dir):
    base = scaled(spark, sf_dir)
    return graph.nearest_centres(base, base.where("id < 4").select(F.col("id").alias("query_id"), "vec"), 2)


def _truth_and_results(spark, sf_dir):
    base, coarse = embeddings(spark, sf_dir), int8s(spark, sf_dir)
    return knn.exact(base, asked(base), 30), knn.exact(coarse, asked(coarse), 20)


_TR = f"""{_V}, td AS (SELECT q.id AS query_id, b.id AS id, {_L2} AS distance FROM v q, v b WHERE q.id % 100 = 0),
    truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM td) WHERE rank <= 30),
    c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)) AS vec FROM embeddings),
    rd AS (SELECT q.id AS query_id, b.id AS id, {_L2} AS distance FROM c q, c b WHERE q.id % 100 = 0),
    res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM rd) WHERE rank <= 20)"""


@query(f"""WITH {_TR}, kth AS (SELECT query_id, max(distance) AS kd FROM truth WHERE rank <= 10 GROUP BY query_id),
    w AS (SELECT t.query_id, t.id FROM truth t JOIN kth USING (query_id) WHERE rank <= 10 OR distance = kd)
    SELECT (SELECT count(*) FROM res JOIN w USING (query_id, id) WHERE rank <= 10) * 100.0::DOUBLE / count(*) / 10 AS recall, count(*) AS n_queries FROM kth""")
def recall_at_k_ties(spark, sf_dir):
    return metrics.recall_at_k(*_truth_and_results(spark, sf_dir), 10)


@query(f"""WITH {_TR}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM truth WHERE id % 11 <> 0),
    kth AS (SELECT query_id, max(distance) AS kd FROM a WHERE nth <= 10 GROUP BY query_id),
    w AS (SELECT a.query_id, a.id FROM a JOIN kth USING (query_id) WHERE nth <= 10 OR distance = kd)
    SELECT (SELECT count(*) FROM res JOIN w USING (query_id, id) WHERE rank <= 10) * 100.0::DOUBLE / count(*) / 10 AS recall, count(*) AS n_queries FROM kth""")
def recall_active_tags(spark, sf_dir):
    return metrics.recall_active(*_truth_and_results(spark, sf_dir), embeddings(spark, sf_dir).where("id % 11 <> 0"), 10)


@query(f"""WITH {_TR}, t AS (SELECT query_id, id FROM td WHERE distance <= 1.2), s AS (SELECT query_id, count(*) AS n, count(res.id) AS f FROM t LEFT JOIN res USING (query_id, id) GROUP BY query_id)
    SELECT avg(CASE WHEN n IS NULL THEN 100.0::DOUBLE ELSE f * 100.0::DOUBLE / n END) AS recall, count(*) AS n_queries FROM (SELECT id AS query_id FROM v WHERE id % 100 = 0) LEFT JOIN s USING (query_id)""")
def range_recall(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    _, results = _truth_and_results(spark, sf_dir)
    return metrics.range_recall(asked(base), knn.in_range(base, asked(base), 1.2), results)


@query(f"""WITH {_S}, d AS (SELECT q.id AS query_id, b.id AS id, {_L2} AS distance FROM v q, v b WHERE q.id % 100 = 0), s AS (SELECT query_id, count(*) AS n FROM d WHERE distance <= 40.0 GROUP BY query_id),
    r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS at_, count(*) OVER () AS c FROM s) SELECT p.share, r.n AS value FROM r, (SELECT unnest([0.5, 0.9, 0.99, 0.999])::DOUBLE AS share) p WHERE at_ = least(floor(p.share * c), c - 1)""")
def query_stats_percentiles(spark, sf_dir):
    base = scaled(spark, sf_dir)
    stats = knn.in_range(base, asked(base), 40.0).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.percentile_at(stats, "n", [0.5, 0.9, 0.99, 0.999])


def _named(spark, sf_dir):
    own = F.array(F.concat(F.lit("L"), "label"), F.concat(F.lit("M"), (F.col("id") % 3).cast("string")))
    return embeddings(spark, sf_dir).select("id", F.when(F.col("id") % 50 == 0, F.concat(own, F.array(F.lit("all")))).otherwise(own).alias("labels"))


@query("""WITH p AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 0 THEN ['L' || label, 'M' || (vec_id % 3), 'all'] ELSE ['L' || label, 'M' || (vec_id % 3)] END AS labels FROM embeddings),
    s AS (SELECT id, unnest(labels) AS label, unnest(range(0, len(labels))) AS place FROM p),
    f AS (SELECT label, min(id * 10 + place) AS at_ FROM s WHERE label <> 'all' GROUP BY label)
    SELECT label, row_number() OVER (ORDER BY at_) AS label_id FROM f UNION ALL SELECT 'all', 0""")
def label_encode(spark, sf_dir):
    return labels.encode(_named(spark, sf_dir), "all")[1]


@query("""WITH p AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 0 THEN [label::BIGINT, 10 + vec_id % 3, 99] ELSE [label::BIGINT, 10 + vec_id % 3] END AS labels FROM embeddings),
    s AS (SELECT id, unnest(labels) AS label, list_contains(labels, 99) AS u FROM p)
    SELECT id, label FROM s WHERE NOT u UNION SELECT a.id, b.label FROM (SELECT DISTINCT id FROM s WHERE u) a, (SELECT DISTINCT label FROM s WHERE label <> 99) b""")
def label_expand_universal(spark, sf_dir):
    return labels.expand_universal(labelled(spark, sf_dir), 99)


_P = "p AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 0 THEN [label::BIGINT, 10 + vec_id % 3, 99] ELSE [label::BIGINT, 10 + vec_id % 3] END AS labels FROM embeddings)"


@query(f"""WITH {_P}, l AS (SELECT count(*) AS n_labels FROM (SELECT DISTINCT unnest(labels) FROM p)), t AS (SELECT count(*) AS n_points, avg((len(labels) >= 3)::INT::DOUBLE) AS dense_share, sum(len(labels)) AS pairs FROM p)
    SELECT n_points, n_labels, dense_share, pairs::DOUBLE / n_points AS labels_per_point, pairs::DOUBLE / n_labels AS points_per_label FROM t, l""")
def label_stats(spark, sf_dir):
    return labels.statistics(labelled(spark, sf_dir), 3)


@query(f"""WITH {_P}, c AS (SELECT label, count(*) AS n_points FROM (SELECT unnest(labels) AS label FROM p) GROUP BY label),
    r AS (SELECT n_points, row_number() OVER (ORDER BY n_points) - 1 AS at_, count(*) OVER () AS n FROM c) SELECT s.share, r.n_points AS value FROM r, (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS share) s WHERE at_ = least(floor(s.share * n), n - 1)""")
def label_size_percentiles(spark, sf_dir):
    return metrics.percentile_at(labels.label_counts(labelled(spark, sf_dir)), "n_points", [i / 10 for i in range(11)])


@query(f"""WITH {_P}, c AS (SELECT label, count(*) AS n_points FROM (SELECT unnest(labels) AS label FROM p) GROUP BY label), r AS (SELECT row_number() OVER (ORDER BY n_points DESC, label) AS place, label, n_points FROM c) SELECT * FROM r WHERE place <= 3""")
def label_top3(spark, sf_dir):
    return labels.top_labels(labelled(spark, sf_dir), 3)


@query(f"""WITH {_P}, s AS (SELECT id, list_sort(labels) AS l FROM p), x AS (SELECT id, unnest(range(0, ceil(len(l) / 2.0)::BIGINT)) AS part, l FROM s),
    y AS (SELECT id, part, l[part * 2 + 1 : part * 2 + 2] AS labels FROM x), m AS (SELECT max(id) AS top FROM p)
    SELECT id AS id, id AS real_id, array_to_string(labels, ',') AS labels FROM y WHERE part = 0
    UNION ALL SELECT top + row_number() OVER (ORDER BY id, part), id, array_to_string(labels, ',') FROM y, m WHERE part > 0""")
def dense_point_split(spark, sf_dir):
    return labels.split_dense(labelled(spark, sf_dir), 2).withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


# ---------------------------------------------------------------- graphs


@query(f"WITH {_E} SELECT src, dst FROM e")
def knn_graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs FROM b GROUP BY src")
def undirected_adjacency(spark, sf_dir):
    return graph.undirected(edges(spark, sf_dir)).select("id", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query(f"WITH {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT count(*) AS n FROM b GROUP BY src) SELECT max(n) AS max_degree, avg(n) AS avg_degree, min(n) AS min_degree, sum((n < 2)::BIGINT)::BIGINT AS n_below_two FROM d")
def degree_stats(spark, sf_dir):
    return graph.degree_stats(graph.undirected(edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_E}, r(id, level) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id WHERE r.level < 32)
    SELECT level, count(*) AS n_nodes FROM (SELECT id, min(level) AS level FROM r GROUP BY id) GROUP BY level""")
def bfs_levels(spark, sf_dir):

    return graph.bfs_levels(edges(spark, sf_dir), embeddings(spark, sf_dir).where("id = 0"), 32)


@query(f"""WITH {_E}, one AS (SELECT src AS start_id, dst AS id FROM e WHERE src % 100 = 0), two AS (SELECT start_id, e.dst AS id FROM one JOIN e ON e.src = one.id)
    SELECT start_id, id FROM (SELECT * FROM one UNION SELECT * FROM two) WHERE start_id <> id""")
def khop_neighborhood(spark, sf_dir):
    return graph.khop(edges(spark, sf_dir), embeddings(spark, sf_dir).where("id % 100 = 0"), 2)


@query(f"""WITH {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY (dst * 2654435761 + src * 40503) % 1000003, dst) AS n FROM b)
    SELECT src, dst FROM r WHERE n <= 10""")
def graph_union_truncate(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.union_truncate([e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))], 10)


@query(f"WITH {_E}, n AS (SELECT count(*) AS n FROM v) SELECT (src * 7) % n AS src, (dst * 7) % n AS dst FROM e, n")
def permute_graph(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    n = base.count()
    return graph.permute(edges(spark, sf_dir), base.select(((F.col("id") * 7) % n).alias("new_id"), F.col("id").alias("old_id")))


# ---------------------------------------------------------------- E: profiles and layouts


@query(f"""WITH {_TRACE}, a AS (SELECT node_id AS id, sum((event = 'expand')::INT)::BIGINT AS n_expand, sum((event = 'visit')::INT)::BIGINT AS n_visit FROM t GROUP BY node_id), o AS (SELECT parent_id AS id, count(*) AS out_heat FROM t WHERE event = 'expand' GROUP BY parent_id)
    SELECT id, coalesce(n_expand, 0) AS n_expand, coalesce(n_visit, 0) AS n_visit, coalesce(out_heat, 0) AS out_heat FROM a FULL JOIN o USING (id)""")
def profile_counters(spark, sf_dir):
    return profile.node_counters(trace(spark, sf_dir))


@query(f"WITH {_TRACE} SELECT parent_id AS u, node_id AS v, count(*) AS cnt FROM t WHERE event = 'expand' GROUP BY ALL")
def profile_edges(spark, sf_dir):
    return profile.edge_counters(trace(spark, sf_dir))


@query(f"""WITH {_TRACE}, s AS (SELECT query_id, hop, string_agg(DISTINCT node_id::VARCHAR, ',' ORDER BY node_id::VARCHAR) AS nodes FROM t WHERE event = 'expand' GROUP BY ALL) SELECT nodes, count(*) AS weight FROM s GROUP BY nodes""")
def hop_templates(spark, sf_dir):
    return profile.hop_templates(trace(spark, sf_dir)).select(F.array_join(F.array_sort(F.col("nodes").cast("array<string>")), ",").alias("nodes"), "weight")


@query(f"""WITH {_NP}, r AS (SELECT n_expand, row_number() OVER (ORDER BY n_expand DESC) - 1 AS at_, count(*) OVER () AS n FROM np WHERE n_expand > 0)
    SELECT p.percent, r.n_expand AS value FROM r, (SELECT unnest([1, 5, 10, 25, 50, 75, 90, 95, 99])::BIGINT AS percent) p WHERE at_ = floor(p.percent * (n - 1) / 100)""")
def profile_cdf(spark, sf_dir):
    return metrics.count_profile(node_profile(spark, sf_dir, edge_profile(spark, sf_dir)), "n_expand")


@query(f"WITH {_EP} SELECT least(u, v) AS u, greatest(u, v) AS v, sum(cnt)::BIGINT AS weight FROM ep GROUP BY ALL")
def edge_weights_undirected(spark, sf_dir):
    return profile.undirected_weights(edge_profile(spark, sf_dir))


@query(f"WITH {_EP} SELECT u AS id, sum(cnt)::BIGINT AS heat FROM ep GROUP BY u")
def parent_out_heat(spark, sf_dir):
    return profile.out_heat(edge_profile(spark, sf_dir))


@query(f"WITH {_EP} SELECT v AS id, sum(cnt)::BIGINT AS heat FROM ep GROUP BY v")
def child_in_heat(spark, sf_dir):
    return profile.in_heat(edge_profile(spark, sf_dir))


@query(f"""WITH {_EP}, {_CH}, {_threshold(0.8)}, h AS (SELECT u AS id, max(total)::BIGINT AS heat, max({_PAGE}) + 1 AS n_pages FROM th WHERE rn <= k GROUP BY u) SELECT id, heat, n_pages, heat::DOUBLE / greatest(1, n_pages) AS benefit FROM h""")
def benefit_density(spark, sf_dir):
    return profile.benefit(edge_profile(spark, sf_dir), 0.8, CAP)


@query(f"WITH {_EP}, {_CH}, {_threshold(0.5)} SELECT u, v, rn, k FROM th WHERE rn <= k")
def pct_threshold_children(spark, sf_dir):
    return profile.threshold(edge_profile(spark, sf_dir), 0.5, CAP).where("rn <= k").select("u", "v", "rn", "k")


@query(f"WITH {_EP}, {_CH} SELECT u, v, rn, {_PAGE} AS page FROM ch")
def page_assignment(spark, sf_dir):
    return profile.pages(edge_profile(spark, sf_dir), CAP)


@query(f"""WITH {_EP}, {_CH}, h AS (SELECT u AS id, max(total)::BIGINT AS heat, sum(CASE WHEN rn <= 4 THEN cnt ELSE 0 END)::BIGINT = max(total) AS covered FROM ch GROUP BY u)
    SELECT row_number() OVER (ORDER BY covered DESC, heat DESC, id) AS place, id, heat, covered FROM h""")
def top4_full_coverage(spark, sf_dir):
    return profile.top4_first(edge_profile(spark, sf_dir))


_TPL = f"{_EP}, {_CH}, tp AS (SELECT list(v ORDER BY v) AS nodes, sum(cnt) AS w FROM ch WHERE rn <= 4 GROUP BY u), tpl AS (SELECT nodes, sum(w)::BIGINT AS weight FROM tp GROUP BY nodes)"


@query(f"WITH {_TPL} SELECT array_to_string(nodes, ',') AS nodes, weight FROM tpl")
def frontier_templates(spark, sf_dir):
    return profile.edge_templates(edge_profile(spark, sf_dir), 4).select(F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), "weight")


@query(f"""WITH {_TPL}, x AS (SELECT row_number() OVER () AS t, nodes, weight FROM tpl), f AS (SELECT t, weight, unnest(nodes) AS id FROM x), g AS (SELECT list(id ORDER BY id) AS nodes, weight FROM f WHERE id % 11 <> 0 GROUP BY t, weight)
    SELECT array_to_string(nodes, ',') AS nodes, sum(weight)::BIGINT AS weight FROM g WHERE len(nodes) >= 2 GROUP BY nodes""")
def templates_eligible(spark, sf_dir):
    x = profile.eligible_templates(profile.edge_templates(edge_profile(spark, sf_dir), 4), embeddings(spark, sf_dir).where("id % 11 <> 0"))
    return x.select(F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), "weight")


@query(f"""WITH {_TPL}, a AS (SELECT row_number() OVER () AS t, nodes, weight FROM tpl), f AS (SELECT t, weight, unnest(nodes) AS n FROM a) SELECT x.n AS u, y.n AS v, sum(x.weight)::BIGINT AS weight FROM f x JOIN f y ON x.t = y.t AND x.n < y.n GROUP BY ALL""")
def cooccur_weights(spark, sf_dir):
    return profile.cooccurrence(profile.edge_templates(edge_profile(spark, sf_dir), 4))


@query(f"""WITH {_EP}, {_CH}, h AS (SELECT u, sum(cnt) AS heat FROM ep GROUP BY u), s AS (SELECT u, row_number() OVER (ORDER BY heat DESC, u) AS place, count(*) OVER () AS n FROM h)
    SELECT ch.u, ch.v FROM ch JOIN s USING (u) WHERE place <= ceil(n * 0.3) AND rn <= ceil(n_children * 0.5)""")
def seed_nbr_sweep_cut(spark, sf_dir):
    return profile.sweep_cut(edge_profile(spark, sf_dir), 0.3, 0.5)


def _profiles(spark, sf_dir, e: DataFrame | None = None):
    ep = edge_profile(spark, sf_dir, e)
    return ep, node_profile(spark, sf_dir, ep)


_HOT = "hot AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n_expand DESC, id) AS place, id, n_expand FROM np WHERE n_expand > 0)"


@query(f"WITH {_NP}, {_HOT} SELECT place - 10 AS place, id, n_expand FROM hot WHERE place > 10 AND place <= 60")
def mem_tier_topn(spark, sf_dir):
    return layouts.memory_tier(_profiles(spark, sf_dir)[1], 50, 10)


@query(f"WITH {_NP}, {_HOT}, x AS (SELECT row_number() OVER (ORDER BY n_expand DESC, id) AS place, id, n_expand FROM hot WHERE place > 50) SELECT * FROM x WHERE place <= 100")
def disk_tier_flat(spark, sf_dir):
    _, np_ = _profiles(spark, sf_dir)
    return layouts.flat(np_, 100, layouts.memory_tier(np_, 50))


@query("SELECT 64 * 4 + 33 * 4 + 64 AS per_node, 1000000 - 200000 - 100000 AS residual, least(500000 // 452, 700000 // 452, count(*))::BIGINT AS n_nodes FROM embeddings")
def plan_memory(spark, sf_dir):
    p = layouts.plan_memory(embeddings(spark, sf_dir).count(), 64, 4, 32, 1_000_000, 200_000, 100_000, 500_000)
    return spark.createDataFrame([(p["per_node"], p["residual"], p["n_nodes"])], "per_node int, residual int, n_nodes bigint")


@query("SELECT (count(*) * 772 * 0.25)::BIGINT AS budget, (count(*) * 772 * 0.25)::BIGINT // 4096 AS sectors, (count(*) * 772 * 0.25)::BIGINT // 4096 * 5 AS n_nodes FROM embeddings")
def plan_disk(spark, sf_dir):
    p = layouts.plan_disk(embeddings(spark, sf_dir).count() * 772, 0.25, 4096, CAP)
    return spark.createDataFrame([(p["budget"], p["sectors"], p["n_nodes"])], "budget bigint, sectors bigint, n_nodes bigint")


def _seed_sql(share: float, order: str, more: str = "") -> str:
    cold = "" if share < 1 else "WHERE rn <= k"
    return f"""{_NP}, {_HOT}, {_CH}, {_threshold(share)},
    el AS (SELECT u, v, total, rn <= k AS hot, row_number() OVER (PARTITION BY u, rn <= k ORDER BY rn) AS rn FROM (SELECT * FROM th {cold}) WHERE v IN (SELECT id FROM hot) AND u IN (SELECT id FROM hot)),
    pg AS (SELECT u, hot, CASE WHEN hot THEN {_PAGE} ELSE floor((rn - 1) / {CAP})::BIGINT END AS page_no, v, rn, total FROM el),
    gr AS (SELECT u AS seed, NOT hot AS is_cold, page_no, list(v ORDER BY rn) AS kids, max(total)::BIGINT AS heat FROM pg GROUP BY u, hot, page_no),
    nh AS (SELECT *, sum((NOT is_cold)::INT) OVER (PARTITION BY seed) AS n_hot FROM gr),
    sq AS (SELECT row_number() OVER (ORDER BY is_cold, page_no, {order}) AS page_seq, seed, page_no, is_cold, CASE WHEN page_no = 0 AND NOT is_cold THEN list_concat([seed], kids) ELSE kids END AS nodes FROM nh WHERE n_hot > 0),
    bf AS MATERIALIZED (SELECT *, coalesce(sum(len(nodes)) OVER (ORDER BY page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sq){more}"""


_PAGES = "SELECT page_seq, seed, page_no, is_cold, array_to_string(nodes, ',') AS nodes, before FROM bf"


def _pages(x: DataFrame) -> DataFrame:
    return x.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


for _share in (0.3, 0.5, 0.8, 0.9, 1.0):

    def _seed_replica(spark, sf_dir, share=_share):
        return _pages(layouts.seed_replica_pages(*_profiles(spark, sf_dir), share, CAP, BUDGET))

    _seed_replica.__name__ = f"layout_seed_replica_pct{round(100 * _share)}"
    query(f"WITH {_seed_sql(_share, 'heat DESC, seed')} {_PAGES} WHERE before < {BUDGET}")(_seed_replica)


for _share in (0.8, 1.0):

    def _seed_benefit(spark, sf_dir, share=_share):
        return _pages(layouts.seed_replica_pages(*_profiles(spark, sf_dir), share, CAP, BUDGET, rank="benefit"))

    _seed_benefit.__name__ = f"layout_seed_benefit_pct{round(100 * _share)}"
    query(f"WITH {_seed_sql(_share, 'heat::DOUBLE / n_hot DESC, heat DESC, seed')} {_PAGES} WHERE before < {BUDGET}")(_seed_benefit)


def _list_sql(budget: int) -> str:
    return f""", sl AS (SELECT before + unnest(range(1, len(nodes) + 1)) AS place, unnest(nodes) AS id FROM bf WHERE before < {budget}), ls AS MATERIALIZED (SELECT place, id FROM sl WHERE place <= {budget})"""


@query(f"WITH {_seed_sql(1.0, 'heat DESC, seed', _list_sql(203))} SELECT place, id FROM ls")
def layout_seed_budget(spark, sf_dir):
    pages = layouts.seed_replica_pages(*_profiles(spark, sf_dir), 1.0, CAP, 203)
    return layouts.node_list(pages, 203)


for _core in (30, 40, 50, 70):

    def _core_fill(spark, sf_dir, core=_core):
        return layouts.core_fill(*_profiles(spark, sf_dir), 1.0, CAP, 300, core / 100)

    _core_fill.__name__ = f"layout_core{_core}_fill"
    query(f"""WITH {_seed_sql(1.0, 'heat DESC, seed', _list_sql(int(300 * _core / 100)))}, mo AS (SELECT row_number() OVER (ORDER BY n_expand DESC, id) + (SELECT max(place) FROM ls) AS place, id FROM hot WHERE id NOT IN (SELECT id FROM ls))
        SELECT place, id FROM (SELECT * FROM ls UNION ALL SELECT * FROM mo) WHERE place <= 300""")(_core_fill)


def _child_sql(only: bool) -> str:
    first = "WHERE fp = 1" if only else ""
    return f"""{_NP}, {_HOT}, {_CH}, {_threshold(0.8)}, c1 AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY total DESC, u) AS fp FROM th WHERE rn <= k AND v IN (SELECT id FROM hot)),
    c2 AS (SELECT u, v, total, row_number() OVER (PARTITION BY u ORDER BY rn) AS n FROM c1 {first}), c3 AS (SELECT u, floor((n - 1) / {CAP})::BIGINT AS page_no, list(v ORDER BY n) AS nodes, max(total) AS heat FROM c2 GROUP BY u, page_no),
    c4 AS (SELECT row_number() OVER (ORDER BY heat DESC, u, page_no) AS page_seq, u AS seed, page_no, nodes FROM c3), c5 AS (SELECT *, coalesce(sum(len(nodes)) OVER (ORDER BY page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c4)
    SELECT page_seq, seed, page_no, array_to_string(nodes[1:203 - before], ',') AS nodes, before FROM c5 WHERE before < 203"""


@query("WITH " + _child_sql(False))
def layout_child_replica(spark, sf_dir):
    return _pages(layouts.child_replica_pages(*_profiles(spark, sf_dir), 0.8, CAP, 203))


@query("WITH " + _child_sql(True))
def layout_child_only(spark, sf_dir):
    return _pages(layouts.child_only_pages(*_profiles(spark, sf_dir), 0.8, CAP, 203))


@query(f"""WITH {_seed_sql(1.0, 'heat DESC, seed')}, sl AS (SELECT page_seq, unnest(range(0, len(nodes))) AS slot, unnest(nodes) AS id FROM bf WHERE before < {BUDGET}), fs AS (SELECT id, min(page_seq * 100 + slot) AS at_ FROM sl GROUP BY id)
    SELECT row_number() OVER (ORDER BY at_ NULLS LAST, n_expand DESC, np.id) - 1 AS new_id, np.id AS old_id FROM np LEFT JOIN fs ON fs.id = np.id""")
def relayout_permutation(spark, sf_dir):
    ep, np_ = _profiles(spark, sf_dir)
    return layouts.permutation(layouts.seed_replica_pages(ep, np_, 1.0, CAP, BUDGET), np_, np_)


@query(f"""WITH {_READS}, d AS (SELECT DISTINCT query_id, sector FROM reads), i AS (SELECT *, sector - row_number() OVER (PARTITION BY query_id ORDER BY sector) AS g FROM d) SELECT query_id, min(sector) AS first, count(*) AS n FROM i GROUP BY query_id, g""")
def coalesce_spans(spark, sf_dir):
    return layouts.spans(reads(spark, sf_dir))


@query(f"WITH {_READS} SELECT query_id, count(*) AS n_reads, count(DISTINCT sector) AS n_distinct, count(*) - count(DISTINCT sector) AS n_hits FROM reads GROUP BY query_id")
def sector_cache_hits(spark, sf_dir):
    return layouts.sector_hits(reads(spark, sf_dir))


@query(f"""WITH {_READS}, s AS (SELECT query_id, abs(sector - lag(sector) OVER (PARTITION BY query_id ORDER BY seq)) AS step FROM reads) SELECT query_id, sum((step > 1)::BIGINT)::BIGINT AS n_jumps, coalesce(sum(step), 0)::BIGINT AS total_jump FROM s GROUP BY query_id""")
def sector_jumps(spark, sf_dir):
    return layouts.sector_jumps(reads(spark, sf_dir))


@query(f"WITH {_READS} SELECT floor(sector * 32.0::DOUBLE / (SELECT max(id) // {CAP} + 1 FROM v))::BIGINT AS bucket, count(*) AS n_reads FROM reads GROUP BY 1")
def sector_histogram(spark, sf_dir):
    last = embeddings(spark, sf_dir).agg(F.max("id")).first()[0] or 0
    return layouts.sector_histogram(reads(spark, sf_dir), last // CAP + 1)


def _requests(spark, sf_dir):
    e = edges(spark, sf_dir).where("(src + dst) % 3 = 0")
    return e.select((F.col("src") % 10).alias("query_id"), (F.col("dst") % 2).alias("hop"), F.col("src").alias("parent"), F.col("dst").alias("child"), F.floor(F.col("dst") % 2).alias("parent_sector"), F.floor(F.col("dst") / CAP).alias("self_sector"))


@query(f"""WITH {_E}, q AS (SELECT src % 10 AS query_id, dst % 2 AS hop, src AS parent, dst AS child, dst % 2 AS ps, dst // {CAP} AS ss FROM e WHERE (src + dst) % 3 = 0),
    g AS (SELECT query_id, hop, parent, count(DISTINCT child) AS n_children, count(DISTINCT ps) AS n_parent, count(DISTINCT ss) AS n_self FROM q GROUP BY ALL) SELECT *, n_children < 2 OR n_parent < n_self AS use_parent FROM g""")
def parent_or_self(spark, sf_dir):
    return layouts.parent_or_self(_requests(spark, sf_dir))


@query(f"""WITH {_NP}, {_HOT}, o AS (SELECT id FROM hot WHERE place <= 100), n AS (SELECT id FROM hot WHERE place > 30 AND place <= 150)
    SELECT (SELECT count(*) FROM o) AS n_old, (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM n)) AS n_evicted, (SELECT count(*) FROM o WHERE id IN (SELECT id FROM n)) AS n_kept""")
def eviction_diff(spark, sf_dir):
    _, np_ = _profiles(spark, sf_dir)
    return layouts.evicted(layouts.memory_tier(np_, 100), layouts.memory_tier(np_, 120, 30))


# ---------------------------------------------------------------- PQ with fixed centres


_CHUNK = _sum("(b.vec[c * 8 + i] - q.vec[c * 8 + i]) * (b.vec[c * 8 + i] - q.vec[c * 8 + i])", "range(8)")
_PQ = f"""{_V}, ch AS (SELECT unnest(range(0, 8)) AS c), cd AS (SELECT q.id, c, b.id AS centre, {_CHUNK} AS d FROM v q, v b, ch WHERE b.id < 16),
    code AS MATERIALIZED (SELECT id, c, centre FROM (SELECT *, row_number() OVER (PARTITION BY id, c ORDER BY d, centre) AS rn FROM cd) WHERE rn = 1)"""


@query(f"WITH {_PQ} SELECT id, string_agg(centre::VARCHAR, ',' ORDER BY c) AS code FROM code GROUP BY id")
def pq_encode(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return pq.encode(base, pq.fixed_codebook(base.where("id < 16"), 8)).select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


@query(f"""WITH {_PQ}, s AS (SELECT t.id AS query_id, code.id AS id, list_reduce(list(t.d ORDER BY t.c), lambda s, x: s + x) AS distance FROM cd t JOIN code ON code.c = t.c AND code.centre = t.centre WHERE t.id % 100 = 0 GROUP BY t.id, code.id),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM s) SELECT * FROM r WHERE rank <= 10""")
def pq_adc_topk(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    book = pq.fixed_codebook(base.where("id < 16"), 8)
    return pq.table_distances(pq.encode(base, book), asked(base), book, 10)


@query(f"""WITH {_PQ}, n AS (SELECT count(*) AS n FROM v) SELECT (id * 7) % n AS id, string_agg(centre::VARCHAR, ',' ORDER BY c) AS code FROM code, n GROUP BY ALL""")
def pq_codes_permuted(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    codes, n = pq.encode(base, pq.fixed_codebook(base.where("id < 16"), 8)), base.count()
    moved = disk.permute_codes(codes, base.select(((F.col("id") * 7) % n).alias("new_id"), F.col("id").alias("old_id")))
    return moved.select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


# ---------------------------------------------------------------- disk layout and what stays in memory


@query(f"""WITH {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), g AS MATERIALIZED (SELECT src AS id, count(*) AS n_nbrs FROM b GROUP BY src),
    p AS (SELECT 4096 // (256 + 4 * (max(n_nbrs) + 1)) AS per, (SELECT count(*) FROM v) AS n FROM g)
    SELECT id, n_nbrs, 1 + id // per AS sector, id % per AS slot, 1 + (n + per - 1) // per + id // 16 AS reorder_sector, id % 16 AS reorder_slot FROM g, p""")
def disk_layout(spark, sf_dir):
    placed = disk.layout(graph.undirected(edges(spark, sf_dir)), embeddings(spark, sf_dir).count(), 64, 4, 64)
    return placed.select("id", F.size("nbrs").cast("bigint").alias("n_nbrs"), "sector", "slot", "reorder_sector", "reorder_slot")


@query(f"""WITH RECURSIVE {_E}, s AS (SELECT 0::BIGINT AS id, -1::BIGINT AS place UNION ALL SELECT min(id), label FROM v WHERE label IS NOT NULL GROUP BY label),
    r(id, level) AS (SELECT id, 0::BIGINT FROM s UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id WHERE r.level < 32),
    l AS MATERIALIZED (SELECT id, min(level) AS level FROM r GROUP BY id),
    p AS (SELECT id, 0 AS level, min(place) AS parent FROM s GROUP BY id UNION ALL
        SELECT c.id, c.level, min(a.id) FROM l c JOIN e ON e.dst = c.id JOIN l a ON a.id = e.src AND a.level = c.level - 1 GROUP BY c.id, c.level),
    o AS (SELECT id, level, row_number() OVER (ORDER BY level, parent, id) AS at_ FROM p), n AS (SELECT greatest(1, least({BUDGET}, floor(count(*) * 0.1 + 0.5)::BIGINT)) AS n FROM v)
    SELECT id, level::BIGINT AS level FROM o, n WHERE at_ <= n.n""")
def cache_list_levels(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    own = base.where("label is not null").groupBy(F.col("label").cast("bigint").alias("place")).agg(F.min("id").alias("id"))
    starts = own.select("id", "place").unionByName(base.where("id = 0").select("id", F.lit(-1).cast("bigint").alias("place")))
    return disk.cache_by_levels(edges(spark, sf_dir), starts, BUDGET, base.count())


@query(f"""WITH {_TRACE}, c AS (SELECT node_id AS id, count(*) AS n FROM t WHERE event = 'visit' GROUP BY node_id), x AS (SELECT v.id, coalesce(c.n, 0) AS n_visits FROM v LEFT JOIN c USING (id))
    SELECT id, n_visits FROM (SELECT *, row_number() OVER (ORDER BY n_visits DESC, id) AS at_ FROM x) WHERE at_ <= {BUDGET}""")
def cache_list_sample_queries(spark, sf_dir):
    visits = trace(spark, sf_dir).where("event = 'visit'").select("query_id", F.col("node_id").alias("id"))
    return disk.cache_by_visits(visits, embeddings(spark, sf_dir), BUDGET)


@query(f"""WITH {_V}, d AS (SELECT q.id AS query_id, b.id AS id, b.label = 3 AS own, {_L2} AS distance FROM v q, v b WHERE q.id % 100 = 0),
    r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS at_, row_number() OVER (PARTITION BY query_id, own ORDER BY distance, id) AS own_at, own FROM d)
    SELECT query_id, id FROM r WHERE at_ <= 10 OR own AND own_at <= 10""")
def candidate_pool_union(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return disk.union_pools(knn.exact(base, asked(base), 10), knn.exact(base.where("label = 3"), asked(base), 10))


@query(f"""WITH {_V}, n AS (SELECT count(*) - 10 AS n FROM v), d AS (SELECT q.id AS query_id, b.id AS id, {_L2} AS distance FROM v q, v b, n WHERE q.id % 100 = 0 AND b.id < n.n),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d) SELECT query_id, rank, id, distance FROM r WHERE rank <= 10""")
def knn_without_frozen(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return disk.without_frozen(knn.exact(base, asked(base), 20), base.count() - 10, 10)


# ---------------------------------------------------------------- D: maintenance


@query("""WITH p AS (SELECT vec_id AS position, (SELECT count(*) FROM embeddings) AS n FROM embeddings), s AS (SELECT unnest(range(200, max(n), 50)) AS step FROM p)
    SELECT step, position FROM p, s WHERE position >= step - 200 AND position < step + 50""")
def sliding_window_live(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return maintenance.window_live(base.select(F.col("id").alias("position")), 200, 50, base.count())


@query("SELECT unnest([1001000, 1001001]) AS id UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 22 = 0")
def lazy_delete_failed(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    wanted = base.where("id % 11 = 0").select("id").unionByName(spark.createDataFrame([(1001000,), (1001001,)], "id bigint"))
    return maintenance.lazy_delete(base, base.where("id % 22 = 0").select("id"), wanted)[1]


@query(f"""WITH {_E} SELECT 'SUCCESS' AS status, count(*) FILTER (WHERE id % 11 <> 0) AS n_live, count(*) FILTER (WHERE id % 11 = 0) AS n_freed, (SELECT count(DISTINCT src) FROM e WHERE dst % 11 = 0 AND src % 11 <> 0) AS n_relinked, 4000 - count(*) FILTER (WHERE id % 11 <> 0) AS n_free FROM v""")
def consolidate_report(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return maintenance.consolidate_report(base, edges(spark, sf_dir), base.where("id % 11 = 0").select("id"), 4000)


@query(f"""WITH {_E} SELECT src, dst FROM e WHERE src % 11 <> 0 AND dst % 11 <> 0 UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src % 11 <> 0 AND a.dst % 11 = 0 AND b.dst % 11 <> 0 AND a.src <> b.dst""")
def process_delete_candidates(spark, sf_dir):
    return maintenance.delete_candidates(edges(spark, sf_dir), embeddings(spark, sf_dir).where("id % 11 = 0").select("id"))


# ---------------------------------------------------------------- workloads


@query(f"""WITH {_TRACE}, x AS (SELECT * FROM t WHERE event = 'expand'), p AS (SELECT (src // 5) * 5 AS seed, dst AS id FROM e WHERE dst % 3 <> 0)
    SELECT count(*) AS n_expanded, count(*) FILTER (WHERE node_id IN (SELECT id FROM p)) AS n_cached, count(*) FILTER (WHERE (parent_id, node_id) IN (SELECT (seed, id) FROM p)) AS n_with_parent FROM x""")
def page_capture(spark, sf_dir):
    from .operators import workloads

    e = edges(spark, sf_dir)
    pages = e.where("dst % 3 <> 0").select((F.floor(F.col("src") / 5) * 5).alias("seed"), F.col("dst").alias("id"))
    return workloads.page_capture(trace(spark, sf_dir, e), pages)


@query(f"WITH {_NP}, {_HOT} SELECT sum(n_expand)::BIGINT AS heat, (SELECT sum(n_expand) FROM hot WHERE place <= 100)::BIGINT AS heat_listed FROM np")
def heat_mass(spark, sf_dir):
    from .operators import workloads

    _, np_ = _profiles(spark, sf_dir)
    return workloads.heat_mass(np_, layouts.flat(np_, 100))


# ---------------------------------------------------------------- B, C, D: no SQL; recall and invariants are tested


def _recall(base, queries, found, k=10, metric="l2"):
    """(recall, n_queries) of a search, beside the exact one."""
    return metrics.recall_at_k(knn.exact(base, queries, 2 * k, metric), found, k)


@query(None)
def vamana_search(spark, sf_dir):
    from .operators import vamana

    base = scaled(spark, sf_dir)
    return _recall(base, asked(base), vamana.search(written(vamana.build(base, 32, 50)), asked(base), 10, 50))


@query(None)
def vamana_sharded_search(spark, sf_dir):
    from .operators import vamana

    base = embeddings(spark, sf_dir)
    return _recall(base, asked(base), vamana.search(written(vamana.build(base, 32, 50, shard_size=400)), asked(base), 10, 50))


@query(None)
def pq_beam_search(spark, sf_dir):
    from .operators import vamana

    base = embeddings(spark, sf_dir)
    index = written(vamana.build(base, 32, 50))
    return _recall(base, asked(base), vamana.search(index, asked(base), 10, 60, book=pq.train(base, 16, 64), beam=4))


@query(None)
def stitched_search(spark, sf_dir):
    from .operators import vamana

    base = labelled(spark, sf_dir)
    index = written(vamana.build_stitched(base, 16, 32, stitched_degree=24))
    queries = asked(base, F.col("label").cast("bigint").alias("label"))
    found = vamana.search(index, queries, 10, 50)
    return metrics.recall_at_k(knn.exact_with_label(base, queries, 20), found, 10)


@query(None)
def filtered_graph_search(spark, sf_dir):
    from .operators import vamana

    base = labelled(spark, sf_dir)
    queries = asked(base, F.col("label").cast("bigint").alias("label"))
    found = vamana.search(written(vamana.build(base, 32, 50, filtered=True)), queries, 10, 50, universal=99)
    return metrics.recall_at_k(knn.exact_with_label(base, queries, 20, universal=99), found, 10)


@query(None)
def range_search_graph(spark, sf_dir):
    from .operators import vamana

    base = embeddings(spark, sf_dir)
    found = vamana.search(written(vamana.build(base, 32, 50)), asked(base), 1, 16, radius=1.2)
    return metrics.range_recall(asked(base), knn.in_range(base, asked(base), 1.2), found)


def _routed(base):
    """A routed index in about seven shards, fewer points each than any shard may have."""
    from .operators import routed, vamana

    size = max(1, min(vamana.SHARD, base.count() // 2))
    return routed.RoutedIndex.build(base, f"{shared_folder(base.sparkSession)}/tables/{uuid.uuid4().hex}", degree=32, complexity=50, shard_size=size, filtered="labels" in base.columns)


@query(None)
def routed_search(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    index = _routed(base)
    return _recall(base, asked(base), index.search(asked(base), 10, 100, max(1, index.meta["shards"] // 2)))


@query(None)
def routed_filtered_search(spark, sf_dir):
    base = labelled(spark, sf_dir)
    queries = asked(base, F.col("label").cast("bigint").alias("label"))
    index = _routed(base)
    found = index.search(queries, 10, 100, index.meta["shards"], universal=99)
    return metrics.recall_at_k(knn.exact_with_label(base, queries, 20, universal=99), found, 10)


@query("SELECT count(*) AS n_points, true AS covered, true AS within FROM embeddings")
def grown_partitions(spark, sf_dir):
    """Whether parts of a fifth of the table cover every vector, once or twice, and hold no more than they may."""
    from .operators import vamana

    base = embeddings(spark, sf_dir)
    most = max(1, base.count() // 5)
    dealt = written(vamana.assign_shards(base.select("id", "vec"), most))
    sizes = dealt.groupBy("shard").count().agg((F.max("count") <= most).alias("within"))
    per = dealt.groupBy("id").count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("copies"))
    n = base.agg(F.count(F.lit(1)).alias("n_points"))
    return n.join(F.broadcast(per)).join(F.broadcast(sizes)).select("n_points", ((F.col("n") == F.col("n_points")) & (F.col("copies") <= 2)).alias("covered"), "within")


_TREE_CENTRES = 16


@query(f"""
    WITH c AS (SELECT vec_id AS part, embedding AS e FROM embeddings WHERE vec_id < {_TREE_CENTRES}),
    d AS (
        SELECT v.vec_id AS id, c.part, list_sum(list_transform(list_zip(v.embedding, c.e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d
        FROM embeddings v, c)
    SELECT id, part::INT AS part, rank FROM (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY d, part) AS rank FROM d) WHERE rank <= 3""")
def tree_nearest_parts(spark, sf_dir):
    """The three nearest of some centres for every vector, through the tree that routes queries."""
    from .operators import partition

    base = embeddings(spark, sf_dir)
    tree = partition.tree_of(base.where(f"id < {_TREE_CENTRES}").select("id", "vec"))
    return partition.nearest_parts(base, tree, 3).select("id", "part", "rank")


@query("SELECT label, ((7 * n + 9) // 10) // label AS n_points FROM (SELECT unnest(range(1, 21)) AS label, (SELECT count(*) FROM embeddings) AS n)")
def label_quotas(spark, sf_dir):
    """How many points each of twenty zipf labels is on, for as many points as there are vectors."""
    dealt = labels.synthetic(spark, embeddings(spark, sf_dir).count(), 20, "zipf")
    return labels.label_counts(dealt).where("label > 0").select(F.col("label").cast("bigint").alias("label"), "n_points")


@query("""
    WITH n AS (SELECT count(*) // 4 AS n FROM embeddings)
    SELECT 'x' AS source, round(0.8 * n)::BIGINT AS n_queries FROM n UNION ALL SELECT 'all', n - round(0.8 * n)::BIGINT FROM n""")
def query_mix_counts(spark, sf_dir):
    """Queries of each source in a mix of a quarter as many queries as vectors; region x are the vectors of label 0."""
    from .operators import workloads

    base = embeddings(spark, sf_dir)
    x, y = base.where("label = 0").select("id"), base.where("label = 1").select("id")
    return workloads.query_mix(base, x, y, base.count() // 4, "mostly_x").groupBy("source").agg(F.count(F.lit(1)).alias("n_queries"))


@query(None)
def maintained_filtered_search(spark, sf_dir):
    """Recall by label after a fifth of the vectors went in and a fifth came out."""
    from .operators import vamana

    base = labelled(spark, sf_dir)
    index = written(vamana.build(base.where("id % 5 <> 4"), 32, 50, filtered=True))
    index = written(vamana.insert(index, base.where("id % 5 = 4"), 32, 50))
    index = written(vamana.consolidate(index, base.where("id % 5 = 3").select("id"), 32))
    left = base.where("id % 5 <> 3")
    queries = asked(base, F.col("label").cast("bigint").alias("label"))
    return metrics.recall_at_k(knn.exact_with_label(left, queries, 20, universal=99), vamana.search(index, queries, 10, 50, universal=99), 10)


@query(None)
def fast_l2_graph_search(spark, sf_dir):
    from .operators import vamana

    base = scaled(spark, sf_dir)
    found = vamana.search(written(vamana.build(base, 32, 50, frozen=2)), asked(base), 10, 50, "fast_l2", random_starts=True)
    return _recall(base, asked(base), found, metric="fast_l2")


@query(None)
def kmeans_clusters(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    centres = pq.kmeans_distributed(base.select("id", "vec"), 8)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "query_id bigint, vec array<double>")
    return graph.nearest_centres(base, table, 1).groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("residual"))


@query(None)
def consolidated_index(spark, sf_dir):
    from .operators import vamana

    base = embeddings(spark, sf_dir)
    left = vamana.consolidate(written(vamana.build(base, 32, 50)), base.where("id % 11 = 0").select("id"), 32)
    return left.agg(F.count(F.lit(1)).alias("n_live"), F.max(F.size("nbrs")).alias("max_degree"))


def _greedy(name: str) -> None:
    def run(spark, sf_dir):
        from .plans import greedy

        e = edges(spark, sf_dir)
        ep, np_ = _profiles(spark, sf_dir, e)
        return greedy.greedy_layout(name, np_, ep, CAP, 300, e)

    run.__name__ = f"layout_{name}"
    query(None)(run)


for _name in ("node", "node_top4first", "edge", "edge_dir", "edge_star", "edge_u", "edge_pair", "edge_clique", "dir_edge_star", "edge_replica", "edge_star_dup", "frontier", "frontier_page", "frontier_dup", "frontier_topk", "cooccur_star", "dbeam_cooccur", "parent", "parent_star", "dbeam_estar_split", "directed_beam", "directed_beam_starfill", "directed_beam_top4first", "directed_beam_inseed", "directed_beam_tight", "directed_beam_dual", "directed_beam_hybrid", "directed_star", "directed_beam_pct30", "directed_beam_pct50", "directed_beam_pct80", "directed_beam_pct90", "directed_beam_pct100", "directed_seed_replica"):
    _greedy(_name)


@query(None)
def lfu_pool(spark, sf_dir):
    from .streaming import pool

    requests = reads(spark, sf_dir).toDF("pool", "seq", "item")
    return pool.replay(requests, 16)
