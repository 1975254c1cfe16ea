"""A corpus from documents: each stage is written as Parquet and reread as the next one's documents.

run(spark, sf_dir) applies STAGES to the table documents. ORACLE_SQL is None: language
identification, fingerprints, sampling by hashed numbers and the encoding are not SQL; the operators
of the stages are tested against brute force, and the stages on small tables.

Nulls: a document with a null or empty text, or one without letters, is rejected by language
identification; a null lang, source or n_chars is kept, a null doc_id too, as the last of its copies.
Of rows that repeat a text one stays. An empty table gives no rows. Columns beyond those of documents
are dropped, whatever their names. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridvane.llm import bpe, exact, langid, mixing, simhash
from gridvane.llm.common import numbered
from gridvane.llm.queries import RANKS
from gridvane.plans.tables import settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if fewer of its letter n-grams than this share belong to the language found.
LEAST_COVERAGE = 0.2


def _kept(docs: DataFrame, groups: Callable[..., DataFrame]) -> DataFrame:
    """The rows of docs that groups() keeps; both sides of the join take a row's number from one written table."""
    docs = numbered(docs.select(*COLUMNS))
    return docs.join(groups(docs, uid=F.col("uid")).where("kept").select("uid"), "uid", "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: without letters, or made of n-grams that no language has."""
    found = langid.predict(docs, langid.train(docs), "doc_id", "text", *COLUMNS[1:])
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("coverage") >= LEAST_COVERAGE)).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest doc_id stays."""
    return _kept(docs, exact.groups)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest doc_id stays."""
    return _kept(docs, simhash.groups)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times."""
    return mixing.repeated(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document of the mix."""
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; in the shared folder, only the documents of the stages stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
