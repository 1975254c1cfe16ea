"""Language identification with language-bitmask n-gram filters.

Letter n-grams that are frequent in a language are put into a bit-sliced Bloom filter: an array of
integers in which bit l of a slot belongs to language l. Two probes of an n-gram, AND-ed, give all
languages that contain it at once. A document's languages are judged by popcounts, one for each bit
over all n-grams of the whole text, corrected for the false positives that the filling of that
language's bit slice predicts.

Training reads at most about `sample_docs` documents of each language (chosen by a hash of the id;
a documented bound), prediction reads every text and sends only the filter (a fixed size) around.

Nulls: a null text, or one without letters, is `und` with score 0. Rows with a null language are
predicted but not learned from. Without any training rows every text is `und`. Ties go to the
language that is first by code point. Repeated rows are predicted each; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, mixed, slices

ORDERS = (3, 4, 5)
UNDETERMINED = "und"
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_ASCII_LETTER = _IS_LETTER.copy()
_IS_LETTER[128:] = True
_CODE = np.where(_IS_LETTER, np.arange(256), 32).astype(np.uint8)
_CODE[65:91] += 32
_K = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (hashes of the n-grams, the row of each), letters only, a space at either end at most."""
    code = _CODE[data]
    keep = np.ones(len(code), bool)
    if len(code):
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        keep[offsets[:-1][offsets[:-1] < len(code)]] = True  # a text's first space is its own, whatever text stands before it
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[keep]
    code = code[keep]
    space, wide = code == 32, code.astype(np.uint64)
    h = np.zeros(len(code), np.uint64)
    done = 0
    for n in ORDERS:
        size = len(code) - n + 1
        if size <= 0:
            return
        h = h[:size].copy()
        for j in range(done, n):
            h += wide[j : j + size] * _K[j]
        done = n
        good = row[:size] == row[n - 1 :]
        for j in range(1, n - 1):
            good &= ~space[j : j + size]
        at = np.flatnonzero(good)
        yield mixed(h[at] + _K[n]), row[at]


@dataclass
class Filter:
    """languages in order of code point; slots: bit l of each belongs to language l; wrong: false-positive rate of each."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        m = np.uint64(len(self.slots) - 1)
        return self.slots[(h & m).astype(np.int64)] & self.slots[((h >> np.uint64(32)) & m).astype(np.int64)]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corrected hits by row and language, n-grams of each row)"""
        n, k = len(offsets) - 1, len(self.languages)
        hits, total = np.zeros((n, k)), np.zeros(n)
        for a, b in slices(offsets):
            for h, row in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                got = self.masks(h)
                total[a:b] += np.bincount(row, minlength=b - a)
                for i in range(k):
                    hits[a:b, i] += np.bincount(row[(got >> got.dtype.type(i)) & got.dtype.type(1) == 1], minlength=b - a)
        return np.maximum(0, (hits - total[:, None] * self.wrong) / np.maximum(1e-9, 1 - self.wrong)), total


def build(by_language: dict[str, np.ndarray], bits: int = 20) -> Filter:
    """A filter of 2**bits slots over the n-gram hashes of each language (64 languages at most)."""
    languages = sorted(by_language)
    if len(languages) > 64:
        raise ValueError("one filter holds 64 languages at most")
    kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= most)
    slots, m = np.zeros(1 << bits, kind), np.uint64((1 << bits) - 1)
    for i, name in enumerate(languages):
        h = by_language[name].astype(np.uint64)
        for at in (h & m, (h >> np.uint64(32)) & m):
            slots[np.unique(at).astype(np.int64)] |= kind(1 << i)
    wrong = np.array([np.mean((slots >> kind(i)) & kind(1)) ** 2 for i in range(len(languages))])
    return Filter(languages, slots, wrong)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 2000, top: int = 40_000, share: float = 0.15) -> Filter:
    """A filter learned from about `sample_docs` documents of each language.

    top: n-grams that a language has at most; share: an n-gram belongs to the languages in which
    its rate is at least so much of its highest rate.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return Filter([], np.zeros(2, np.uint8), np.zeros(0))
    limit = spark.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in sizes.items()], "its_lang string, rate double")
    luck = F.shiftrightunsigned(F.xxhash64("id", F.lit(1)), 11) / float(1 << 53)
    sample = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("its_lang"), F.col(text_col).alias("text"))
    sample = sample.join(F.broadcast(limit), "its_lang").where(luck <= F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for name in set(lang):
                data, offsets = flat(batch.column(1).filter(pa.array(lang == name)))
                for a, b in slices(offsets, 1 << 22):
                    for h, _ in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        g, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["its_lang", "gram", "n"])

    counts = sample.select("its_lang", "text").mapInArrow(count, "its_lang string, gram bigint, n bigint").groupBy("its_lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("its_lang"))
    counts = counts.withColumn("r", rate).withColumn("best", F.max("r").over(Window.partitionBy("gram"))).where(F.col("r") >= share * F.col("best"))
    counts = counts.withColumn("k", F.row_number().over(Window.partitionBy("its_lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= top)
    rows = counts.select("its_lang", "gram").toArrow()  # `top` rows for each language at most
    lang, gram = np.array(rows.column(0).to_pylist(), object), rows.column(1).to_numpy().view(np.uint64)
    return build({name: gram[lang == name] for name in sizes})


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, more..., lang_pred, score, coverage) of every row; more: columns that are passed through.

    score: the winner's share of the corrected popcounts, scaled so that an even spread is 0 and a
    single language 1; coverage: the winner's corrected popcount over the n-grams of the text.
    """
    keep = [id_col, *more]
    names = [f"k{i}" for i in range(len(keep))]
    sent = [(c, n) for c, n in zip(keep, names) if c != text_col]  # the text crosses to Python once
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = flat(column)
            corrected, total = model.counts(data, offsets)
            passed = [column if c == text_col else batch.column(batch.schema.get_field_index(n)) for c, n in zip(keep, names)]
            some = np.zeros(len(offsets) - 1, bool)
            for a, b in slices(offsets):
                letters = np.flatnonzero(_ASCII_LETTER[data[offsets[a] : offsets[b]]])
                some[a:b] = np.diff(np.searchsorted(letters, offsets[a : b + 1] - offsets[a])) > 0
            for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
                some[i] = any(map(str.isalpha, column[int(i)].as_py()))
            best = corrected.argmax(1) if k else np.zeros(len(some), int)
            top = corrected.max(1) if k else np.zeros(len(some))
            part = top / np.maximum(1e-9, corrected.sum(1)) if k else top
            score = np.where(some & (top > 0), (part - 1 / k) / (1 - 1 / k) if k > 1 else part, 0.0)
            pred = [model.languages[j] if s and k else UNDETERMINED for j, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays(
                [*passed, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.where(some, top / np.maximum(1, total), 0.0))],
                [*names, "lang_pred", "score", "coverage"],
            )

    rows = docs.select(*[F.col(c).alias(n) for c, n in sent], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, coverage double").toDF(*keep, "lang_pred", "score", "coverage")
