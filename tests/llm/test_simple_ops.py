"""op1, op2, op5, op7 and op8 against brute force, and their edge cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

from gridvane.llm import bpe, exact, langid, mixing, quality, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, gram string, size bigint, uid string"
LONG = "abc def ghi " * 3000 + "x" * 20000
ROWS = [
    (1, "One  small\ttext, one small text", "en", "a", 5, "x", 1, "u"),
    (2, "One small text, one\nsmall text", "en", "a", 5, None, 1, "u"),
    (2, "One small text, one\nsmall text", "en", None, 5, None, 1, "u"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "x", 1, "u"),
    (None, "le petit texte de la été", "fr", "b", 0, "x", 1, "u"),
    (5, "12 34 %% \x1f é", "fr", "b", 0, "x", 1, "u"),
    (6, LONG, "fr", "", 0, "x", 1, "u"),
    (7, LONG, None, "\U0001f600", 0, "x", 1, "u"),
    (8, "   x\u0085y\x1cz  \r\n\n á 漢字 ' 's DON'T 'll", "de", "￿", 0, "x", 1, "u"),
]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})


def test_bpe_like_tiktoken(spark, odd, none):
    own = encoding()
    for docs in (odd, documents(spark), none):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).collect())
        want = []
        for r in docs.collect():
            ids = own.encode_ordinary(r.text or "")
            want.append((r.doc_id if r.doc_id is not None else -1, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), (r.text or "").encode()))
        assert got == sorted(want)


def test_bpe_white_space_and_letters_of_all_planes():
    own, coder = encoding(), bpe.encoder(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    text = "".join(f"a{chr(c)} {chr(c)}1" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    for at in range(0, len(text), 500):
        part = text[at : at + 500]
        ids = coder.encode(part)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == own.encode_ordinary(part)


def test_exact_groups(spark, odd, none):
    assert exact.groups(none).count() == 0
    rows = exact.groups(odd).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(list)
    for r in ROWS:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    for r in rows:
        same = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.doc_id in same and r.group_size == len(same) and r.keep_id == min(x for x in same if x is not None or len(same) == 1)
    assert sum(r.kept for r in rows) == len(by)


def test_exact_with_clashing_chunk_hash(spark):
    docs = documents(spark)
    weak = lambda x: len(x) % 3
    good = sorted(tuple(r)[:5] for r in exact.groups(docs).drop("uid").collect())
    assert sorted(tuple(r)[:5] for r in exact.groups(docs, short=weak).drop("uid").collect()) == good


def test_exact_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op7_exact_dedup"]).fetchall()
    got = queries.op7_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute_targets(sizes, most=3.0):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: i % 3 + 1.0 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= most * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def brute_mix(rows):
    """(id, size, copies) of rows (id, size, source, u): the rule of mixing.mix, in plain Python."""
    sizes = collections.Counter()
    for _, n, s, _ in rows:
        sizes[s] += n
    target, out = brute_targets(sizes), []
    for s in sizes:
        e = min(3.0, target[s] / sizes[s]) if sizes[s] else 0.0
        whole = int(e)
        lack, ranked = target[s] - whole * sizes[s], []
        own = [r for r in rows if r[2] == s]
        weight = lambda n: min(1, mixing.UPSET * lack / (n >> max(0, n.bit_length() - 7) << max(0, n.bit_length() - 7)))
        low, high = -60.0, 60.0
        for _ in range(200):  # the scale at which words times probability add up to what is lacking
            c = math.exp((low + high) / 2)
            less = sum(n * (c * weight(n) / (1 + c * weight(n))) for _, n, _, _ in own if n) < lack
            low, high = ((low + high) / 2, high) if less else (low, (low + high) / 2)
        for i, n, _, u in own:
            if n and lack > 0:
                ranked.append((u / (1 - u) / (c * weight(n)), i is not None, i or 0, n, i))
            else:
                out.append((i, n, whole if n else 0))
        done = 0
        for _, _, _, n, i in sorted(ranked):
            done += n
            out.append((i, n, whole + (done - n / 2 <= lack)))
    return sorted(map(str, out))


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_mixing(spark, odd, which):
    from pyspark.sql import functions as F

    docs = odd if which == "odd" else documents(spark)
    rows = mixing.mix(docs).drop("uid").collect()
    assert len(rows) == docs.count()
    luck = collections.defaultdict(list)
    for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), 8).alias("u")).collect():
        luck[r.doc_id].append(r.u)
    assert sorted(str((r.doc_id, r.size, r.copies)) for r in rows) == brute_mix([(r.doc_id, r.size, r.source, luck[r.doc_id][0]) for r in rows])
    size, longest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    target = brute_targets(size)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
    again = mixing.mix(docs.repartition(3)).drop("uid").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


@pytest.mark.parametrize("large", [1, 400])
def test_inclusion_is_as_stated(spark, large):
    """Over seeds, documents are sampled as often as p says, and p times words adds up to what is lacking.

    large: words of every fourth document over those of the others; 400 times as long, one alone
    would upset the target.
    """
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "a " * (5 * (large if i % 4 == 0 else 1)), "xyz"[i % 3]) for i in range(2400)], "doc_id bigint, text string, source string")
    sizes = mixing.word_counts(docs, "doc_id", "text", "source").toDF("doc_id", "source", "size").toPandas()
    more, seeds = collections.Counter(), 5
    for seed in range(seeds):
        rows = mixing.mix(docs.repartition(2), seed=seed).toPandas()
        for r in rows.itertuples():
            more[r.source, r.size] += r.copies - r.target // r.source_size
    for s, own in rows.groupby("source"):
        whole = own.target.iloc[0] // own.source_size.iloc[0]
        assert (own.p * own["size"]).sum() == pytest.approx(own.target.iloc[0] - whole * own.source_size.iloc[0], abs=1e-3)
        for n, same in own.groupby("size"):
            assert same.p.nunique() == 1
            # five standard deviations of independent draws, which fixed-size sampling stays within
            p, k = same.p.iloc[0], len(same) * seeds
            assert abs(more[s, n] / k - p) <= 5 * math.sqrt(p * (1 - p) / k) + 0.5 / len(same)
    assert len(sizes) == 2400
    if large == 1:
        assert rows.groupby("source").p.nunique().max() == 1


def test_mixing_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, "k"), (2, "c", "y", 8, None)], "doc_id bigint, text string, source string, uid int, __copies string")
    got = {tuple(r) for r in mixing.repeated(docs).collect()}
    assert got <= {tuple(r) for r in docs.collect()} and got


def test_mixing_words(odd, none):
    got = {r.doc_id: r.size for r in mixing.word_counts(odd, "doc_id", "text").toDF("doc_id", "size").collect()}
    assert got == {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS}
    assert mixing.mix(none).count() == 0
    want = {r.uid: r.copies for r in mixing.mix(odd).collect()}
    assert mixing.repeated(odd).count() == sum(want.values()) and mixing.repeated(odd).columns == odd.columns


def test_language_id(spark, odd, none):
    rows = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    held = [(r.lang, rows[r.doc_id].lang_pred) for r in documents(spark).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in rows)
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    model = langid.train(documents(spark))
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0 and got[None].lang_pred == "fr"
    assert got[5].lang_pred in ("fr", "es", "de", "en") and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}


def test_filter_finds_every_gram():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = {n: rng.integers(0, 2**63, 5000, dtype=np.uint64) for n in ("a", "b", "c")}
    f = langid.build(sets, 16)
    for i, n in enumerate(f.languages):
        assert ((f.masks(sets[n]) >> np.uint8(i)) & 1).all()
    fresh = f.masks(rng.integers(0, 2**63, 50000, dtype=np.uint64))
    for i in range(3):
        assert abs(np.mean((fresh >> np.uint8(i)) & 1) - f.wrong[i]) < 0.01


def test_quality(spark, odd, none):
    rows = {r.doc_id: r for r in queries.op2_quality(spark, SF).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(label[k], rows[k].score, rows[k].predicted) for k in label if k in rows and rows[k].held_out]
    good, bad = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.9 * len(good) * len(bad)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (1, 1)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, quality.train(odd, labels)).collect())
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(none, quality.train(none, labels)).count() == 0


def test_trees_walk_like_a_plain_descent():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    t = quality.fit(x, y, rounds=20)
    out = []
    for r in x:
        s = t.base
        for f, c, leaf in zip(t.feature, t.limit, t.leaf):
            k = 0
            for _ in range(t.depth):
                k = 2 * k + 1 + int(r[f[k]] > c[k])
            s += leaf[k - 2**t.depth + 1]
        out.append(1 / (1 + np.exp(-s)))
    assert np.allclose(out, t.score(x)) and np.mean((t.score(x) > 0.5) == y) > 0.95
