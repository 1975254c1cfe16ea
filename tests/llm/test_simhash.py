"""op10 against brute force; connected components; the pipeline's stages."""

import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gridvane.llm import queries, simhash
from gridvane.llm.components import components

from .test_simple_ops import ROWS, SCHEMA, SF, documents


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """prints: (id, print) rows; the smallest id reachable from each."""
    label = {p: p for _, p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    values = sorted(label)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                label[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for k, p in prints:
        ids.setdefault(root(p), []).append(k)
    return {p: min((x for x in ids[root(p)] if x is not None), default=None) for _, p in prints}


@pytest.mark.parametrize("which", ["odd", "sf", "none"])
def test_groups(spark, which):
    docs = documents(spark) if which == "sf" else spark.createDataFrame(ROWS if which == "odd" else [], SCHEMA)
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    smallest = brute_groups(rows)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.groups(docs).collect())
    assert got == sorted((str(k), f"{p:016x}", smallest[p]) for k, p in rows)


def test_near_like_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 2)).astype(np.uint64)
    values = np.unique(base[rng.integers(0, 40, 400)] ^ flips[:, 0] ^ flips[:, 1])
    sizes = np.array([1, 2, 63, 64, 65, len(values) - 195])
    i, j = simhash.near(values, sizes)
    group = np.repeat(np.arange(6), sizes)
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if a != b and group[a] == group[b] and int(values[a] ^ values[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(2)
    values = {int(1 << int(a)) ^ int(1 << int(b)) ^ (int(c) << 40) for a, b, c in rng.integers(0, 40, (300, 3))}
    prints = spark.createDataFrame([(v,) for v in values], "fp bigint")
    whole = {(r.node, r.component) for r in components(simhash.links(prints)).collect()}
    assert whole == {(r.node, r.component) for r in components(simhash.links(prints, tile=16)).collect()}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 6000 + i) for i in range(40)]
    label = list(range(7000))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 3), (9, 9)], "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_pipeline_stages(spark):
    docs = documents(spark).collect()
    now = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [len(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from gridvane.llm.common import written

        now = written(stage(spark, now, SF))
        assert now.columns == corpus_pipeline.COLUMNS
        counts.append(now.count())
        if name == "language":
            assert {r.doc_id for r in now.collect()} >= {r.doc_id for r in docs if sum(map(str.isalpha, r.text or "")) > 20}
        if name == "exact_copies":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in now.collect()]
            assert len(norm) == len(set(norm))
        if name == "near_copies":
            prints = [(r.doc_id, brute_print(r.text)) for r in now.collect()]
            assert len(set(brute_groups(prints).values())) == len(prints)
            kept = {r.doc_id: r.text for r in now.collect()}
        if name == "mix":
            assert all(kept[r.doc_id] == r.text for r in now.collect())
    assert counts[2] < counts[1] <= counts[0] and counts[3] <= counts[2]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == counts[4]
    assert queries.op10_simhash(spark, SF).columns == ["doc_id", "fingerprint", "component_id"]


@pytest.mark.parametrize("name, module, operator", [("exact_copies", "exact", "groups"), ("near_copies", "simhash", "groups"), ("mix", "mixing", "mix")])
def test_stages_do_not_depend_on_splits(spark, tmp_path, monkeypatch, name, module, operator):
    """The next scan packs files otherwise, as when executors come or go between two scans."""
    documents(spark).repartition(12).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    module, stage = getattr(corpus_pipeline, module), dict(corpus_pipeline.STAGES)[name]
    want = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
    plain, setting = getattr(module, operator), "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)

    def then_changed(*args, **options):
        out = plain(*args, **options)
        spark.conf.set(setting, str(1 << 30))
        return out

    monkeypatch.setattr(module, operator, then_changed)
    try:
        assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == want
    finally:
        spark.conf.set(setting, before)
