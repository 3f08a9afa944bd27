"""The pair occurrence index against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from regioscope.llm import bpe, queries
from tokenizers import Tokenizer

PATH = queries.vocabulary("word_bpe_49k.json")
ODD = [
    None, "", "  \n\t ", "Don't WE'LL o'clock 's'S", "a" * 3000, "ab" * 2000, "x<|endoftext|><|startoftext|>y <|endoftext|", "<|<|endoftext|>|>", "1234 ½ Ⅷ", "éÉ é ﬁ İstanbul ΣΑΣ ς",
    "中文字 한국어 日本語。", "a b c　d\x85e\x0bf\x1cg", "😀👩‍💻 x​y﻿", "≠ a,́b", "...!!!'s?'t", "end.", "\x00\x01\x02",
]


def want(texts):
    tok = Tokenizer.from_file(PATH)
    return [(e.ids, tok.decode(e.ids, skip_special_tokens=False)) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts(spark):
    rnd = random.Random(11)
    alphabet = "abcXYZ019 .,'<|>\t\n éÉßİΣ̧ 中가"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ODD
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.row.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    for i, (ids, text) in enumerate(want(texts)):
        assert got[i] == (ids, text), texts[i]


def test_query(spark):
    rows = queries.documents(spark, "/root/testdata/sf0.001").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_pair_index_bpe"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r, (ids, text) in zip(rows, want([r.text for r in rows]), strict=True):
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_rows(spark):
    df = spark.createDataFrame([(None, "one two", 1), (7, "one two", 2), (7, "one two", 2), (None, None, None)], "doc_id bigint, text string, row int")
    got = [(r.row.doc_id, r.row.row, r.decoded) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, "one</w> two</w>"), (7, 2, "one</w> two</w>"), (7, 2, "one</w> two</w>"), (None, None, "")], key=str)
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0
    bad = spark.createDataFrame([(bytearray(b"caf\xff\xe6\x97x"),)], "b binary").selectExpr("cast(b as string) text")
    assert bpe.encode(bad, PATH).first().ids == want([b"caf\xff\xe6\x97x".decode("utf-8", "replace")])[0][0]


def test_unknown_and_null_ids(spark):
    df = spark.createDataFrame([([5, 10**6, None, -1, 6],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).collect()] == ["& '", "", ""]


@pytest.mark.parametrize("most", [3, 50])
def test_table_starts_anew(most, monkeypatch):
    monkeypatch.setattr(bpe.Units, "MOST", most)
    units, texts = bpe.Units(bpe.Vocabulary(PATH)), [f"word{i % 40} next{i % 7}" for i in range(200)]
    expected = [ids for ids, _ in want(texts)]
    for k in range(0, 200, 20):
        raw = [t.encode() for t in texts[k : k + 20]]
        ids, at = units.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == expected[k : k + 20]


def test_lower_rank_after_a_merge():
    """A vocabulary where a merge makes pairs of a lower rank: each word still merges its least pair, leftmost first."""
    v = bpe.Vocabulary.__new__(bpe.Vocabulary)
    a, b, ab, aba, bb = 0, 1, 2, 3, 4
    v.merges = [(ab, a, aba), (a, b, ab), (b, b, bb)]
    v.with_next, v.with_previous, v.early = {ab: {a: 0}, a: {b: 1}, b: {b: 2}}, {a: {ab: 0}, b: {a: 1, b: 2}}, {1}
    v.inner = v.last = np.array([b if c == ord("b") else a for c in range(256)])
    keys = sorted((x << 32 | y, r) for r, (x, y, _) in enumerate(v.merges))
    v.pair_keys, v.pair_ranks = np.array([k for k, _ in keys]), np.array([r for _, r in keys])

    def plain(word):
        s = [b if c == "b" else a for c in word]
        rank = {(x, y): (r, z) for r, (x, y, z) in enumerate(v.merges)}
        while found := [(rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]:
            _, i = min(found)
            s[i : i + 2] = [rank[s[i], s[i + 1]][1]]
        return s

    words = ["".join("ab"[n >> i & 1] for i in range(k)) for k in range(1, 10) for n in range(1 << k)]
    ids, at = v.encode_words([w.encode() for w in words])
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [plain(w) for w in words]
