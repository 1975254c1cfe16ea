"""op6 against brute force."""

import collections
import hashlib

import numpy as np
import pytest

from gridvane.llm import exchange, queries, suffix

from .test_simple_ops import ROWS, SCHEMA, SF, documents


def brute(rows):
    raw = [(k, (t or "").encode()) for k, t in rows]
    seen = collections.Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    out = []
    for k, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i] += 1
                if i + 400 <= len(b):
                    gone[i + 400] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((str(k), len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made():
    rng = np.random.default_rng(12)
    letters = list("abcdefgh é")
    text = lambda n: "".join(rng.choice(letters, n))
    shared = [text(n) for n in (399, 400, 401, 450, 900, 3000)]
    out = []
    for k in range(60):
        parts = [text(int(rng.integers(0, 300))) for _ in range(3)]
        for _ in range(int(rng.integers(0, 3))):
            s = shared[int(rng.integers(0, 6))]
            if rng.random() < 0.5:  # a copy with an edit
                at = int(rng.integers(0, len(s)))
                s = s[:at] + "X" + s[at + 1 :]
            parts.insert(int(rng.integers(0, 3)), s)
        out.append((k, "".join(parts)))
    long = text(500)
    return [*out, (100, "a" * 1200), (101, "b" * 400), (102, "ab" * 600), (103, "b" * 399), (104, long + "?" + long), (105, "a" * 401), (None, long), (7, "xyz" * 150)]


@pytest.mark.parametrize("which", ["odd", "sf", "made", "none"])
def test_like_brute_force(spark, which, monkeypatch):
    if which == "sf":
        docs = documents(spark).where("length(text) < 20000").limit(120)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    else:
        docs = spark.createDataFrame({"odd": ROWS, "none": [], "made": [(k, t, None, None, None, None, None, None) for k, t in made()]}[which], SCHEMA)
    if which == "made":
        monkeypatch.setattr(exchange, "ROWS", 10)
        monkeypatch.setattr(suffix, "bucket_bits", lambda size: 2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = suffix.clean(docs).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == brute(rows)
    if which == "made":
        assert sum(r.n_removed for r in out) > 10000
    if which == "sf":
        assert queries.op6_suffix_dedup(spark, SF).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
