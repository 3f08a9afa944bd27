"""Learned and sampled operators: laws, round trips, held-out accuracy, null and empty cases."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from regioscope.llm import common, kernel, langid, resample, shards, suffix, toxicity, winnow

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None), (0, None, "en"), (1, "", "en"), (2, " \n", None), (3, "a", "de"), (4, "the", "en"), (4, "the", "en"), (5, "x" * 5000, "fr"), (6, "é 日本", None), (7, "123 !!", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, "z", 1) for i, t, g in ODD], "doc_id bigint, text string, lang string, row string, y int")


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


def empty(spark, like):
    return spark.createDataFrame([], like.schema)


def test_matrix_margins():
    counts, sizes = [5, 0, 17, 3], [7, 6, 6, 6]
    m = shards.matrix(counts, sizes, 1)
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes


@pytest.mark.parametrize("n", [24, 5])
def test_shards_exact(docs, odd, spark, n):
    for df in (docs, odd):
        rows = shards.shard(df, shards=n, partitions=16).collect()
        want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        count = Counter(r.shard for r in rows)
        assert max(count.values()) - min(count[s] if s in count else 0 for s in range(n)) <= 1
        for s in count:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    assert shards.shard(empty(spark, docs), shards=n).count() == 0


def test_shards_are_uniform(docs):
    rows = shards.shard(docs, shards=4, partitions=16).collect()
    low = Counter(r.shard for r in rows if r.doc_id < 250)
    assert all(35 <= low[s] <= 95 for s in range(4))


def test_draws_beyond_the_generator_are_hypergeometric(monkeypatch):
    monkeypatch.setattr(shards, "DRAWN", 4)
    rng = np.random.default_rng(5)
    good, bad, n = 40, 25, 30
    got = np.bincount([shards.hypergeometric(rng, good, bad, n) for _ in range(20_000)], minlength=31)
    want = np.array([math.comb(good, k) * math.comb(bad, n - k) for k in range(31)]) / math.comb(good + bad, n) * 20_000
    on = want > 20
    assert ((got - want)[on] ** 2 / want[on]).sum() < 40  # about a dozen cells
    monkeypatch.undo()
    big = shards.hypergeometric(rng, 3 * 10**12, 10**12, 10**11)
    assert abs(big - 0.75e11) < 1e6


def test_equal_rows_are_spread(spark):
    rows = shards.shard(spark.range(4000).selectExpr("cast(null as bigint) doc_id", "'' as text"), shards=4, partitions=16).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(1000)]


def test_kth_largest(spark):
    v = np.random.default_rng(0).integers(0, 1 << 62, 3000).tolist() + [7] * 50
    df = spark.createDataFrame([(int(x),) for x in v], "b bigint")
    for k in (1, 17, 3000, 3020, 3050):
        assert resample.kth_largest(df, "b", k) == sorted(v, reverse=True)[k - 1]


def test_resampling_is_gumbel_top_k(docs, spark):
    labels = common.read(spark, SF, "labels")
    got = resample.resample(docs, labels).toPandas()
    k = int(got.selected.sum())
    assert set(got.nlargest(k, "sample_key").doc_id) == set(got[got.selected].doc_id)
    known = got.merge(labels.toPandas(), on="doc_id")
    assert known[known.quality == 1].selected.mean() > 0.97
    assert known[known.quality == 0].selected.mean() < 0.2


def test_resampling_weights_against_plain_counts(spark):
    texts = [(0, "a b a"), (1, "b c"), (2, "c d e f"), (3, None)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    good = spark.createDataFrame([(0, 1), (2, 0)], "doc_id bigint, quality int")
    got = {r.doc_id: r.log_weight for r in resample.log_weights(df, good, bins=1 << 16)[0].collect()}
    grams = {i: [*(w := (t or "").split()), *zip(w, w[1:])] for i, t in texts}
    raw, target, bins = Counter(g for x in grams.values() for g in x), Counter(grams[0]), 1 << 16
    rt, tt = sum(raw.values()) + bins * 0.5, sum(target.values()) + bins * 0.5
    for i, g in grams.items():
        assert got[i] == pytest.approx(sum(np.log((target[x] + 0.5) / tt) - np.log((raw[x] + 0.5) / rt) for x in g), abs=1e-5)


def test_resampling_hard_cases(odd, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert resample.resample(odd, none).where("selected").count() == len(ODD)
    assert resample.resample(empty(spark, odd), none).count() == 0


def test_toxicity_held_out(docs, spark):
    labels = common.read(spark, "/root/testdata/sf0.1", "labels")
    big = common.read(spark, "/root/testdata/sf0.1", "documents")
    got = toxicity.toxicity(big, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_machine_learns_pairs_only():
    rng = np.random.default_rng(1)
    rows = [(rng.random(2) < 0.5).astype(int) for _ in range(1500)]
    bins = [np.array([10 * (k + 1) for k in range(2) if x[k]] + [77] * int(rng.random() < 0.3), np.int64) for x in rows]
    y = np.array([float(x[0] and x[1]) for x in rows])
    m = toxicity.fit(bins, y, epochs=60)
    score = lambda *b: m.score(np.array(b, np.int64), np.array([0, len(b)]))[0]
    assert score(10, 20) > 0.5 > max(score(10), score(20), score())


def test_machine_learns_pairs_without_marginal_signal():
    rng = np.random.default_rng(2)
    rows = rng.random((3000, 2)) < 0.5
    y = (rows[:, 0] == rows[:, 1]).astype(float)  # neither term tells anything alone
    bins = [np.array([10 * (k + 1) for k in range(2) if x[k]] + rng.integers(100, 400, 20).tolist(), np.int64) for x in rows]
    m = toxicity.fit(bins, y, epochs=60)
    assert m.at[10] >= 0 and m.at[20] >= 0
    score = lambda *b: m.score(np.array(b, np.int64), np.array([0, len(b)]))[0]
    assert score(10, 20) > max(score(10), score(20))


def test_machine_against_plain_sum():
    rng = np.random.default_rng(4)
    at = np.full(toxicity.BINS, -1)
    at[[5, 9, 70]] = [0, 1, 2]
    m = toxicity.Machine(at, -0.3, rng.normal(size=3), rng.normal(size=(3, 4)))
    bins = np.array([5, 5, 9, 1234, 70, 9, 9])
    x = {0: 1 + math.log(2), 1: 1 + math.log(3), 2: 1.0}
    z = m.bias + sum(m.w[i] * v for i, v in x.items()) + sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for i in x for j in x if i < j)
    assert m.score(bins, np.array([0, 7]))[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_hard_cases(odd, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_held_out(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_hard_cases(odd, spark):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        t = next(t for i, t, _ in ODD if i == r.doc_id)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid.identify(empty(spark, odd)).count() == 0


def test_kneser_ney_against_plain_recursion():
    texts = {"a": ["abracadabra abba", "cab bad", "abra"], "b": ["xyz zyx", "yyx axa", "zzz"]}
    m = langid.train(texts)
    prob = brute.kneser_ney(texts, floor=m.floor)
    for t in ("abra xyz", "qq", "bad zyx a"):
        data, offs = kernel.text_arrays(pa.array([t]))
        got = langid.judge(m, data, offs)[0][0]
        p = "   " + t
        for k, g in enumerate(m.langs):
            want = -sum(math.log2(prob(g, p[i - 3 : i + 1])) for i in range(3, len(p))) / len(t)
            assert got[k] == pytest.approx(want, rel=1e-5)


def test_language_draw_is_by_text(spark):
    en = [(1, f"the house number {k} stands near the river and the old mill", "en") for k in range(3000)]
    fr = [(10 + k, f"la maison numero {k} est pres de la riviere et du moulin", "fr") for k in range(4)]
    marks = [(99, "\u0301\u0302 \u0303", None)]
    got = langid.identify(spark.createDataFrame(en + fr + marks, "doc_id bigint, text string, lang string")).collect()
    assert {r.lang_pred for r in got if r.doc_id == 1} == {"en"} and {r.lang_pred for r in got if 10 <= r.doc_id < 20} == {"fr"}
    assert [r.lang_pred for r in got if r.doc_id == 99] == ["und"]


def test_kneser_ney_sums_to_one():
    m = langid.train({"a": ["abracadabra abba", "cab bad"], "b": ["xyz zyx", "yyx"]})
    alphabet = sorted(set("abracdxyz "))
    for before in ("abr", "zzz", "   ", "xy "):
        q = np.array([[*map(ord, before), ord(c)] for c in alphabet], np.uint32)
        total = m.prob_of(q, langid.ORDER).sum(0)
        assert (total < 1).all() and (total > 0.5).all()  # the rest is the floor of letters never seen
        data, offs = kernel.text_arrays(pa.array([before + c for c in alphabet]))
        assert len(langid.judge(m, data, offs)[0]) == len(alphabet)


def plain_winnow(text):
    """Grams in order, and the number of hashes."""
    import re

    low = text.lower()
    grams = [low[m.start() : m.start() + 32] for m in re.finditer(r"(?:(?<!\S)|(?<=\S{16}))(?=\S.{31})\S", low, re.ASCII | re.S)]
    return grams, len(grams) or int(bool(re.search(r"\S", text, re.ASCII)))


def test_winnowing_against_plain_minima(docs, spark):
    from pyspark.sql import functions as F

    text = {i: t or "" for i, t in docs.where("doc_id < 60").select("doc_id", "text").collect()}
    grams = {i: plain_winnow(t)[0] for i, t in text.items()}
    every = sorted({g for u in grams.values() for g in u})
    key = dict(zip(every, [r.h for r in spark.createDataFrame([(g,) for g in every], "g string").select(F.shiftrightunsigned(F.xxhash64("g"), 28).alias("h")).collect()], strict=True))
    df = winnow.fingerprints(docs.where("doc_id < 60"), "text", "fp", 32, 16).select("doc_id", winnow.rendered("fp").alias("fp"), winnow.hashes("fp").alias("h"))
    pairs = df.select("h").limit(2).collect()
    for r in df.collect():
        h = [key[g] for g in grams[r.doc_id]]
        if h:
            assert r.fp == ",".join(f"{h[p]:x}@{p}" for p in brute.minima(h))
    a, b = (set(p.h) for p in pairs)
    both = spark.createDataFrame([(sorted(a), sorted(b))], "a array<bigint>, b array<bigint>")
    assert both.select(winnow.likeness("a", "b")).first()[0] == len(a & b) / len(a | b)


@pytest.mark.parametrize("w", [1, 2, 3, 5, 7, 16, 21])
def test_windows_of_any_width(spark, w):
    import re

    from pyspark.sql import functions as F

    words = " ".join(f"w{i * i % 17}" for i in range(90))
    grams = [words[m.start() : m.start() + 5] for m in re.finditer(r"(?<!\S)(?=\S.{4})", words)]
    h = [r.h for r in spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i int, g string").orderBy("i").select(F.shiftrightunsigned(F.xxhash64("g"), 28).alias("h")).collect()]
    kept = sorted({max(range(a, a + w), key=lambda i: (-h[i], i)) for a in range(len(h) - w + 1)})
    got = winnow.fingerprints(spark.createDataFrame([(words,)], "text string"), "text", "fp", 5, w).select(winnow.rendered("fp")).first()[0]
    assert got == ",".join(f"{h[p]:x}@{p}" for p in kept)


def test_unrelated_neighbours_share_nothing(docs):
    rows = winnow.edited_fingerprints(docs).collect()
    assert sum(r.near_next > 0 for r in rows) < 0.01 * len(rows)
    long = [r for r in rows if r.n_chars > 1500]
    assert sum(r.near_edited > 0.2 for r in long) > 0.99 * len(long)


def test_null_and_repeated_ids(spark):
    import hashlib

    from pyspark.sql import functions as F

    rows = [(None, "no id one"), (None, "no id two"), (None, None), (5, "five a"), (5, "five b"), (5, "five b"), (3, ""), (9, "nine " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = df.withColumn("tie", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)).orderBy(F.desc_nulls_last("doc_id"), "tie").collect()
    texts = [r.text or "" for r in order]
    want = sorted((r.doc_id, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()) for r, t, nxt in zip(order, texts, texts[1:] + texts[:1], strict=True) if r.doc_id is not None)
    got = winnow.edited_fingerprints(df).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 3


def test_winnowing_contract_and_guarantee(docs, odd):
    import hashlib

    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {r.doc_id: r for r in winnow.edited_fingerprints(df).collect()}
        text = {i: t or "" for i, t in df.select("doc_id", "text").collect()}
        ids = sorted(text, reverse=True)
        for n, i in enumerate(ids):
            t, nxt = text[i], text[ids[(n + 1) % len(ids)]]
            cut = len(t) // 3
            assert rows[i].n_chars == len(t)
            assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
            pos = [int(x.split("@")[1]) for x in rows[i].fingerprint.split(",") if x]
            _, n_hash = plain_winnow(t)
            mine, next_, edited = ({x.split("@")[0] for x in f.split(",") if x} for f in (rows[i].fingerprint, rows[ids[(n + 1) % len(ids)]].fingerprint, rows[i].edited_fingerprint))
            alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            assert rows[i].near_next == pytest.approx(alike(mine, next_)) and rows[i].near_edited == pytest.approx(alike(mine, edited))
            assert pos == sorted(pos) and (len(pos) == 0) == (n_hash == 0)
            edges = [-1, *pos, n_hash]
            assert all(b - a <= 16 for a, b in zip(edges, edges[1:])) or n_hash < 16  # every window holds a kept position
            assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        same = {}
        for i, t in text.items():
            assert same.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_winnowing_minimum_is_rightmost(spark):
    df = spark.createDataFrame([(1, "ab " * 60)], "doc_id bigint, text string")
    fp = winnow.fingerprints(df, "text", "fp", 32, 16).select(winnow.rendered("fp")).first()[0]
    assert [int(x.split("@")[1]) for x in fp.split(",")] == list(range(15, 50))  # all hashes are equal: the last of each window


def test_winnowing_ranges(docs, spark):
    one = docs.select("doc_id", "text")
    got = winnow.with_neighbour(one, "doc_id", ["text"], rows_a_range=50).collect()
    text = dict(one.collect())
    assert all(r.next_text == text[r.doc_id - 1 if r.doc_id else 999] for r in got) and len(got) == 1000
    assert winnow.edited_fingerprints(empty(spark, docs)).count() == 0


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(0)
    data = np.frombuffer(bytes(rng.integers(97, 99, 600).tolist()) + b"a" * 120, np.uint8)
    group = np.sort(rng.integers(0, 5, 400))
    at = rng.integers(0, 600, 400)
    order = suffix.suffix_sort(data, kernel.prefix_hash(data), group, at, 100)
    raw = data.tobytes()
    keys = [(int(group[i]), raw[at[i] : at[i] + 100]) for i in order]
    assert keys == sorted(keys)
    want = sorted(range(400), key=lambda i: (group[i], raw[at[i] : at[i] + 100], i))
    assert order.tolist() == want


def test_anchors_cover_every_window():
    rng = np.random.default_rng(2)
    for text in (bytes(rng.integers(97, 101, 3000).tolist()), b"a" * 400, b"abc" * 150, b"x" * 100):
        h, p, a, b = suffix.anchors(np.frombuffer(text, np.uint8), 100)
        starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)])
        assert np.sort(starts).tolist() == list(range(len(text) - 99))
        assert ((p >= b) & (p <= a + 76)).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, int(x)) for x in range(101, 140)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    got = dict(common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect())
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}
