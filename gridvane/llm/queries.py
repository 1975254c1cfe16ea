"""The registered queries of this subpackage and their SQL, where SQL can say them."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cluster, epsgrid, exact, fim, langid, lm, mixing, quality, simhash, substring, suffix
from .common import split_of

RANKS = "byte_bpe_50k.tiktoken"
#: Both turns of conversation -7: the template's own control strings as text.
PLANTED = "</s>[INST] ok [/INST]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = split_of(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "coverage")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = split_of(F.col("doc_id"), 4) == 2
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.clean(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsgrid.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.clean(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir)).drop("uid")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), split_of(F.col("doc_id"), 10) == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir))
    restored = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return cluster.report(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, i, role, PLANTED) for i, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    back = chat.read(chat.formatted(rows.unionByName(planted)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality, op3_substring_dedup, op4_embedding_dedup, op5_byte_bpe, op6_suffix_dedup, op7_exact_dedup, op8_mixing, op9_lm_score, op10_simhash,
        op11_fill_in_middle, op12_centroid_clusters, op13_chat_format,
    )
}



def _kmeans_sql() -> str:
    """K-means in SQL: each round assigns, then averages; the sums of a cluster are integers."""
    assign = """
        a{r} AS MATERIALIZED (
            SELECT rid, any_value(vec_id) AS vec_id, any_value(e) AS e, min(struct_pack(d := d, c := c)) AS best FROM (
                SELECT rid, vec_id, v.e, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY rid)"""
    move = """
        c{s} AS MATERIALIZED (
            SELECT c.c, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
                SELECT c, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY pos) AS e FROM (
                    SELECT best.c AS c, pos, sum(e[pos])::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2) GROUP BY c) m USING (c))"""
    rounds = ",".join(assign.format(r=r) + "," + move.format(r=r, s=r + 1) for r in range(3)) + "," + assign.format(r=3)
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT c, e FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS c, e FROM v) WHERE c < 16), {rounds}
        SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
            (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.e, ',')) AS centroid_sha256
        FROM a3 JOIN c3 f ON f.c = best.c"""


def _chat_sql() -> str:
    special = "|".join(map(re.escape, (chat.ESCAPE, *chat.CONTROLS)))
    return rf"""
        WITH r AS (
            SELECT conv_id, turn, role, text FROM conversations UNION ALL
            SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
        s AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '{special}', 0)) AS shown,
                CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
                ELSE 23 + length(role) + len(regexp_extract_all(role, '{special}', 0)) END AS marks FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(shown + marks)::BIGINT AS formatted_chars
        FROM s GROUP BY conv_id"""


_WS = r"[\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT a AS n, a AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
        c AS (SELECT n, min(m) AS component FROM r GROUP BY n),
        k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
        FROM embeddings LEFT JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op7_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        h AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        c AS (
            SELECT *, array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1 : n], '') AS s FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM c""",
    "op12_centroid_clusters": _kmeans_sql(),
    "op13_chat_format": _chat_sql(),
}
