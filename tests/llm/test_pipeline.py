"""The pipeline's stages one after another, on small and odd tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridvane.llm import langid, mixing

from .test_simhash import brute_groups, brute_print
from .test_simple_ops import ROWS, SCHEMA, SF, brute_mix, documents, encoding


def through(spark, docs):
    """The documents after each stage, and what the last one returns."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_odd_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(*r[:6], r[6], "z") for r in ROWS], SCHEMA)  # with columns size and uid
    language, exact, near, mix, tokens = through(spark, docs)
    rows = {(r[0], r[1]) for r in ROWS}
    for stage in (language, exact, near, mix):
        assert stage.columns == corpus_pipeline.COLUMNS and {(r.doc_id, r.text) for r in stage.collect()} <= rows
    assert not {None, ""} & {r.text for r in language.collect()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    kept = language.collect()
    assert sorted(norm(r.text) for r in exact.collect()) == sorted({norm(r.text) for r in kept})
    for r in exact.collect():
        same = [x.doc_id for x in kept if norm(x.text) == norm(r.text) and x.doc_id is not None]
        assert r.doc_id == min(same, default=None)
    assert near.count() <= exact.count() and {r.text for r in mix.collect()} <= {r.text for r in near.collect()}
    coded = encoding()
    want = sorted((str(r.doc_id), len(ids := coded.encode_ordinary(r.text)), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()) for r in mix.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in tokens.collect()) == want


def test_empty_table(spark):
    assert [d.count() for d in through(spark, spark.createDataFrame([], SCHEMA))] == [0] * 5


def plain_grams(text):
    """The n-grams of letters, with a space at either end at most, as tuples of byte codes."""
    codes = []
    for b in (text or "").encode():
        c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or not codes or codes[-1] != 32:
            codes.append(c)
    for n in langid.ORDERS:
        for i in range(len(codes) - n + 1):
            if 32 not in codes[i + 1 : i + n - 1]:
                yield tuple(codes[i : i + n])


def plain_hash(gram):
    m = (1 << 64) - 1
    h = (sum(c * int(langid._K[j]) for j, c in enumerate(gram)) + int(langid._K[len(gram)])) & m
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & m
    return h ^ (h >> 31)


def plain_language(model, text):
    """(language, score, coverage) of one text, n-gram by n-gram."""
    k, size = len(model.languages), len(model.slots) - 1
    if not k or not any(map(str.isalpha, text or "")):
        return "und", 0.0, 0.0
    hits, total = [0] * k, 0
    for gram in plain_grams(text):
        h = plain_hash(gram)
        got = int(model.slots[h & size]) & int(model.slots[(h >> 32) & size])
        total += 1
        for i in range(k):
            hits[i] += got >> i & 1
    right = [max(0.0, (x - total * w) / max(1e-9, 1 - w)) for x, w in zip(hits, model.wrong)]
    best = max(range(k), key=lambda i: (right[i], -i))
    part = right[best] / max(1e-9, sum(right))
    score = 0.0 if not right[best] else (part - 1 / k) / (1 - 1 / k) if k > 1 else part
    return model.languages[best], min(1.0, max(0.0, score)), right[best] / max(1, total)


def test_language_like_plain(spark):
    docs = documents(spark)
    model = langid.train(docs)
    odd = spark.createDataFrame([*ROWS, (70, " le début", "fr", "a", 1, "x", 1, "u"), (71, "fin ", "fr", "a", 1, "x", 1, "u"), (72, "  mot", "fr", "a", 1, "x", 1, "u")], SCHEMA)
    for rows in (docs, odd.coalesce(1), odd.repartition(4)):
        for r in langid.predict(rows, model, "doc_id", "text", "text").collect():
            lang, score, coverage = plain_language(model, r.text)
            assert (r.lang_pred, pytest.approx(r.score), pytest.approx(r.coverage)) == (lang, score, coverage)


def test_run_like_plain(spark):
    """The whole run against plain versions of its stages, one after another."""
    docs = documents(spark)
    model = langid.train(docs)
    rows = []
    for r in docs.collect():
        lang, _, coverage = plain_language(model, r.text)
        if lang != "und" and coverage >= corpus_pipeline.LEAST_COVERAGE:
            rows.append(r)
    same = {}
    for r in rows:
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), []).append(r)
    rows = [min(g, key=lambda r: r.doc_id) for g in same.values()]
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    least = brute_groups(prints)
    rows = [r for r, (_, p) in zip(rows, prints) if least[p] == r.doc_id]
    luck = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), 8).alias("u")).collect()}
    copies = {eval(t)[0]: eval(t)[2] for t in brute_mix([(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text)), r.source, luck[r.doc_id]) for r in rows])}
    coded, want = encoding(), []
    for r in rows:
        ids = b"".join(i.to_bytes(4, "little") for i in coded.encode_ordinary(r.text))
        want += [(r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] * copies[r.doc_id]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
