"""op11, op12 and op13 against brute force and SQL, and their edge cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridvane.llm import chat, cluster, fim, queries

from .test_simple_ops import ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


def oracle(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df)
    return con.execute(queries.ORACLE_SQL[name]).df()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    row = lambda df: sorted((tuple(None if v != v else v for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)
    assert row(got) == row(want)


@pytest.mark.parametrize("name,table", [("op11_fill_in_middle", "documents"), ("op12_centroid_clusters", "embeddings"), ("op13_chat_format", "conversations")])
def test_like_sql(spark, name, table):
    got = queries.QUERIES[name](spark, SF)
    same(got.toPandas(), oracle(name, **{table: pq.read_table(f"{SF}/{table}.parquet")}))


# ---------------------------------------------------------------- fill in the middle


@given(st.lists(st.booleans(), max_size=400))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(bits):
    own, where = fim.Bits(np.array(bits, bool)), np.flatnonzero(bits)
    assert own.rank(np.arange(len(bits) + 1)).tolist() == [sum(bits[:i]) for i in range(len(bits) + 1)]
    assert own.select(np.arange(len(where))).tolist() == where.tolist()


def plain_fim(doc_id, text, seed="7", rate=100, spm=50):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "\n", "\n\n\n", "one", "a\nb", "é\n漢字\n\U0001f600", "x<P>y\nz", "<S>", "a <M", "<\n<\n<S\n", "\r\n\u2028\n", "line\n" * 70_000, "w" * 3_000_000, "w" * 2_000_000 + "\nend"]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50)])
def test_fim_like_plain(spark, rate, spm):
    rows = [(i, TEXTS[i % len(TEXTS)], 1, "x") for i in range(90)] + [(4, "one", 1, "x"), (4, "one", 1, "x"), (None, "a\nb\nc", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, output string")
    made = fim.transform(docs, rate=rate, spm=spm).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((i, *plain_fim(i, t, rate=rate, spm=spm)) for i, t, _, _ in rows), key=str)
    assert sorted((r.doc_id is None, r.back) for r in made.collect()) == sorted((i is None, t or "") for i, t, _, _ in rows)
    odd = spark.createDataFrame(ROWS, SCHEMA)
    assert fim.transform(odd).count() == len(ROWS) and fim.transform(odd.limit(0)).collect() == []


# ---------------------------------------------------------------- centroids


def plain_kmeans(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cents = [[sum(t) // len(t) for t in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == j]) else c for j, c in enumerate(cents)]
    final = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in final if c == j) for j in range(k)}
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in final]


@pytest.mark.parametrize("kind", ["near", "ties", "large", "few"])
def test_clusters_like_plain(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "ties":  # many vectors as far from several centroids
        x = rng.integers(0, 2, (300, 64)) / 64
        x[100:200] = x[7]
    elif kind == "large":  # products beyond what float32 holds
        x = np.round(rng.normal(0, 3e4, (1, 64))) + rng.integers(-1, 2, (200, 64)) / 64
    else:
        x = rng.normal(0, 0.2, (5 if kind == "few" else 300, 64))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(500, None), (501, []), (502, [0.0] * 63), (503, [None] + [0.0] * 63), (504, [float("nan")] * 64), (505, [float("inf")] * 64), (None, [-0.01] * 64), rows[1], rows[1]]
    df = spark.createDataFrame([(i, v, 9, 9) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, id bigint")
    got = cluster.report(*cluster.clusters(df)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_kmeans(rows), key=str)


def test_clusters_empty_and_too_large(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert cluster.report(*cluster.clusters(none)).collect() == []
    huge = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large for exact distances"):
        cluster.clusters(huge)


@given(st.integers(0, 2**32), st.sampled_from([3, 1000, 1 << 20, 1 << 26]))
@settings(max_examples=40, deadline=None)
def test_nearest_is_exact(seed, size):
    """Centroids one step apart, far from the origin: float32 alone would err."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-size, size, 64)
    cents, x = base + rng.integers(-1, 2, (16, 64)), base + rng.integers(-2, 3, (50, 64))
    cents[9] = cents[2]
    want = [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(cents)) for v in x]
    who, distance = cluster.nearest(x, cents)
    assert list(zip(distance.tolist(), who.tolist())) == want


def test_screen_decides_most():
    """The screen leaves few vectors to integers where centroids are apart, and never drops the nearest."""
    rng = np.random.default_rng(1)
    cents = rng.integers(-64, 64, (16, 64))
    x = cents[rng.integers(0, 16, 5000)] + rng.integers(-9, 10, (5000, 64))
    possible = cluster.screened(x, cents)
    assert (possible.sum(1) > 1).sum() < 50
    assert possible[np.arange(5000), ((x[:, None] - cents) ** 2).sum(2).argmin(1)].all()


# ---------------------------------------------------------------- chat

PIECES = [*chat.CONTROLS, "\\", "\\\\", " ", "", "<", "[", "/", "s>", "a", "\n", "é", "\U0001f600", "<s", "INST]"]
text = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), text)


@given(st.lists(st.tuples(roles, text), max_size=6))
@settings(max_examples=300, deadline=None)
def test_conversations_come_back(turns):
    whole, loss = chat.conversation(turns)
    assert [t[:2] for t in chat.parsed(whole)] == turns
    assert [chat.unescaped(whole[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    # no control string of a text is left unescaped: what the lexer finds are the turns' own marks
    marks = [m for m in chat._TOKEN.findall(whole) if m[0] != chat.ESCAPE]
    assert marks == [m for r, _ in turns for m in (chat.MARKS[r] if r in chat.MARKS else (chat.ROLE, chat.TEXT, chat.END))]


def test_only_conflicts_are_escaped():
    assert chat.turn("user", "a < b [x] / <ss>") == "[INST] a < b [x] / <ss> [/INST]"
    assert chat.turn("assistant", "</s>\\") == "<s> \\</s>\\\\ </s>"
    assert chat.parsed("[INST] a </s> [/INST]") is None and chat.parsed("[INST] a") is None and chat.parsed("x[INST] a [/INST]") is None
    assert chat.parsed("") == []


def test_chat_tables(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), "".join(rng.choices(PIECES, k=6)), "x", 1) for c in range(20) for t in rng.sample(range(12), 8)]
    rows += [(3, 5, "user", "again", "x", 1)] * 3 + [(3, None, "assistant", None, "x", 1), (None, 1, "assistant", "</s>", "x", 1), (None, 0, "user", "", "x", 1), (50, 1, "assistant", "long </s> " * 200_000, "x", 1)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, said bigint")
    back = chat.read(chat.formatted(table))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in back.collect()}
    want = {}
    for c, t, role, said, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        want.setdefault(c, []).append((role or "", said or ""))
    assert got == {c: (v, "".join(t for r, t in v if r == "assistant")) for c, v in want.items()}
    assert chat.read(chat.formatted(table.limit(0))).collect() == []


def test_chat_sql_on_odd_texts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "t<s>"]), "".join(rng.choices(PIECES, k=6)), 1) for c in range(30) for t in range(5)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_chat_format"](spark, str(tmp_path)).toPandas()
    same(got, oracle("op13_chat_format", conversations=table.toPandas()))
    assert {-7} <= set(got.conv_id)
