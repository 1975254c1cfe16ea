"""op3 against brute force, and the packed lists."""

import hashlib
import re

import numpy as np
import pytest

from gridvane.llm import exchange, queries, substring

from .test_simple_ops import ROWS, SCHEMA, SF, documents


def brute(rows):
    texts = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    rank = lambda k: float("inf") if k is None else k
    least = {}
    for k, w in texts:
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            least[x] = min(least.get(x, float("inf")), rank(k))
    out = []
    for k, w in texts:
        gone = set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < rank(k):
                gone |= set(range(i, i + 13))
        out.append((str(k), len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def made():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choice(vocabulary, n)) for n in (12, 13, 14, 20, 60, 200)]
    out = []
    for k in range(120):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(4)]
        for _ in range(rng.integers(0, 4)):
            parts.insert(int(rng.integers(0, 4)), passages[int(rng.integers(0, 6))])
        out.append((int(rng.integers(0, 100)), " \n".join(parts)))
    return [*out, (5, "a " * 40), (6, "a " * 13), (None, passages[4]), (200, passages[4]), (None, "x y " * 10), (201, "x y " * 10)]


@pytest.mark.parametrize("which", ["odd", "sf", "made", "none"])
def test_like_brute_force(spark, which, monkeypatch):
    if which == "sf":
        docs = documents(spark)
    else:
        docs = spark.createDataFrame({"odd": ROWS, "none": [], "made": [(k, t, None, None, None, None, None, None) for k, t in made()]}[which], SCHEMA)
    if which == "made":
        monkeypatch.setattr(exchange, "CHUNK", 8 << 10)
        monkeypatch.setattr(substring, "bucket_bits", lambda size: 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = substring.clean(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out) == brute(rows)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in out)
    if which == "sf":
        assert queries.op3_substring_dedup(spark, SF).count() == len(rows) and sum(r.n_removed for r in out) > 0


def test_many_texts_in_a_chunk(spark, monkeypatch):
    """More texts than a packed number of 19 bits would hold, in one chunk, and buckets of a table of 100 TB."""
    from pyspark.sql import functions as F

    pairs = [(k, " ".join(f"w{k % 200}x{i}" for i in range(13))) for k in range(400)]
    empty = spark.range(1000, 901_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    docs = empty.unionByName(spark.createDataFrame(pairs, "doc_id bigint, text string"))
    monkeypatch.setattr(exchange, "ROWS", 1 << 30)
    for bits in (0, 23):
        monkeypatch.setattr(substring, "bucket_bits", lambda size, bits=bits: bits)
        out = substring.clean(docs if not bits else docs.where("doc_id < 1000")).where("n_removed > 0")
        assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(k, 13) for k in range(200, 400)]


def test_deltas():
    rng = np.random.default_rng(8)
    for top, n in ((1 << 26, 1000), (1 << 20, 50000), (1 << 32, 10), (70000, 3)):
        v = np.unique(np.concatenate([rng.integers(0, top, n), [0xFFFF, 0xFFFE, 2 * 0xFFFF]])).astype(np.uint64)
        assert (exchange.from_deltas(exchange.to_deltas(v)) == v.astype(np.int64)).all()
    assert len(exchange.from_deltas(exchange.to_deltas(np.zeros(0)))) == 0 and exchange.from_deltas(exchange.to_deltas(np.array([0, 65535]))).tolist() == [0, 65535]
