"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from regioscope.llm import collocations, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, most=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for d in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = {}
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        longer = defaultdict(int)
        for p, n in found.items():
            if len(p) == 3:
                longer[p[:2]], longer[p[1:]] = max(longer[p[:2]], n), max(longer[p[1:]], n)
        got = []
        for p, a in found.items():
            if len(p) == 2 and p in longer and 100 * longer[p] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out[lang] = [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(got)[:most])]
    return [x for rows in out.values() for x in rows]


def same(got, rows, **more):
    got = sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(plain(rows, **more))
    return got


def some_rows(seed, n=1500):
    rnd = random.Random(seed)
    words = ["a", "b", "B", "ab", "a\x01", "a\x00", "ä", "日本", "x-y", "it's", "(c)", "\x7f"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?", ";:"]
    rows = [("".join(rnd.choice(words[: rnd.choice((3, 12))]) + rnd.choice(ends) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None, "und", "ä"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (None, None), (" ,. ", "de")] + rows[:50]


@pytest.mark.parametrize("a_range", [1_000_000, 400])
def test_plain(spark, a_range):
    rows = some_rows(1)
    df = spark.createDataFrame([(t, x, i) for i, (t, x) in enumerate(rows)], "text string, lang string, w1 int").repartition(5)
    got = collocations.best(collocations.collocations(df, a_range=a_range), 2000)
    assert len(same(got, rows)) > 200
    assert {r.lang for r in got.collect()} == {"en", "de", "und", "ä"}


def test_first_of_many(spark):
    rows = some_rows(2)
    df = spark.createDataFrame(rows, "text string, lang string")
    same(collocations.best(collocations.collocations(df), 7), rows, most=7)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.text, r.lang) for r in queries.documents(spark, sf).select("text", "lang").collect()]
    assert len(same(queries.QUERIES["op13_trie_collocations"](spark, sf), rows)) > 1000


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.best(collocations.collocations(df), 10).count() == 0
    assert collocations.best(collocations.collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")), 10).count() == 0


def test_words_that_are_not_text(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe caf\xe9 x"),)] * 12, "b binary").select(F.col("b").cast("string").alias("text"), F.lit("en").alias("lang"))
    got = collocations.collocations(df).collect()
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [(12, 12, 12, 36, 1000000)]


def test_cut_trie_is_the_trie():
    """Tries written in small parts, cut anywhere and merged again, are the whole counts."""
    import numpy as np
    from regioscope.llm import kernel as K

    rows = some_rows(3, 120)
    raw = [(t or "").encode() for t, _ in rows]
    pieces = []
    for most in (7, 50, 10_000):
        held = collocations.Tries(3)
        for _ in held.add(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), ["x"] * len(raw), most):
            pass
        for _, first, n, _, data in held.chunks():
            keys, counts, words = collocations.unpack_trie(data)
            assert len(keys) == n and collocations.path_of(int(keys[0]), words) == first
            for a in range(0, n, 13):
                pieces.append(collocations.pack_trie(keys[a : a + 13], counts[a : a + 13], words))
    a, b, c, n, words = collocations.merge(random.Random(1).sample(pieces, len(pieces)))
    got = {tuple(words[i - 1].decode() for i in path if i): k for *path, k in zip(a.tolist(), b.tolist(), c.tolist(), n.tolist())}
    want = Counter()
    for t, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for d in (1, 2, 3):
                want.update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    assert got == {p: 3 * k for p, k in want.items()}
    assert K.LOWER[65] == 97
