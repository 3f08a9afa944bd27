"""Operators against brute force over whole small tables and over made-up hard cases."""

import hashlib
import os
from collections import defaultdict

import pytest

import brute
from regioscope.llm import common, decontaminate, jaccard, packing, queries, sentences, suffix

SF = "/root/testdata/sf0.001"
P = "".join(chr(97 + (i * i * 7 + i * 3) % 26) + (" " if i % 6 == 5 else "") for i in range(900))
Q = " ".join(f"w{i * 37 % 101}x{i}" for i in range(400))
HARD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one two"), (5, "One TWO"), (6, P), (7, P), (8, P[:300] + "zzz" + P[300:]),
    (9, "é" * 60 + P[:120] + "é" * 60), (10, "é" * 60), (11, "a" * 500), (12, "a" * 350 + "b"), (13, "ab" * 200), (14, "x. y! z?\n\n. ."),
    (15, Q), (16, Q.replace("w0x0", "changed")), (17, Q + " tail"), (18, P[200:320]), (19, "q" + P[201:321]), (20, P[:99]), (21, P[:100]),
    (22, "Oneded " * 100), (23, "Oneded " * 70 + "sting"), (24, "First sentence of a long passage here, with words. Second sentence goes on with several more words. " * 2),
    (25, "Lead. First sentence of a long passage here, with words. Second sentence goes on with several more words. Tail"),
    (26, "don't  stop\n \nit's 'quoted' 12,345.67 a b  c €5 ×÷ ½x <|endoftext|> \U0001f600\U0001f600"), (27, "日本語のテキスト。もう一つ"), (28, "\r\n\x0b\x0c\x85 x\x1fy"),
]


def rows_of(spark):
    return [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["hard", "table", "empty"])
def docs(request, spark):
    rows = {"hard": HARD, "table": rows_of(spark), "empty": []}[request.param]
    return rows, spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, row string, items int")


def test_jaccard(docs):
    rows, df = docs
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard.jaccard_classes(df).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_blocks(spark):
    rows = HARD + [(100 + i, Q.replace(f"x{i} ", f"y{i} ")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard.jaccard_classes(df, block=8).collect()}
    assert got == brute.jaccard(rows)


def test_substrings(docs):
    rows, df = docs
    got = suffix.dedup_substrings(df, keep=["doc_id", "row"], cut_text=True).collect()
    want = brute.substrings(rows)
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_substrings_heavy(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(suffix, "HEAVY", 0)
    got = suffix.dedup_substrings(df, keep=["doc_id"]).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.substrings(rows)


def test_sentences(docs):
    rows, df = docs
    got = sentences.dedup_sentences(df, keep=["doc_id", "row"], cut_text=True).collect()
    want = dict(zip([i for i, _ in sorted(rows)], brute.sentences([t for _, t in sorted(rows, key=lambda r: r[0])]), strict=True))
    assert {r.row.doc_id: (r.n_sentences, ",".join(map(str, r.removed))) for r in got} == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("block_bytes", [32 << 20, 64])
def test_decontamination(docs, spark, block_bytes):
    rows, df = docs
    items = [(1, P[30:200]), (2, "One two"), (3, None), (4, ""), (5, Q[100:300]), (5, "y z"), (None, "quoted"), (6, "quoted")]
    items += [(r.item_id + 100, r.text) for r in common.read(spark, SF, "benchmark").collect()] if block_bytes > 64 else []
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(df, bench, keep=["doc_id", "row"], block_bytes=block_bytes, cut_text=True).collect()
    sha = lambda x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
    assert {r.row.doc_id: (r.n_words, r.n_hit, len(r["items"]), sha(r["items"]), r.n_hit > 0) for r in got} == brute.decontaminate(rows, items)
    assert all((r.clean_text is None) == (r.n_hit == 0) for r in got)


def test_packing(docs):
    from tokenizers import Tokenizer

    rows, df = docs
    tok = Tokenizer.from_file(queries.vocabulary())
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got, seqs = defaultdict(list), defaultdict(list)
    for window in (2048, 64):
        got.clear(), seqs.clear()
        for r in packing.pack(df, queries.vocabulary(), window=window, with_ids=True, added=True).collect():
            ids = want[r.doc_id][r.start : r.start + r.length]
            assert list(r.ids) == ids
            assert (r.ids_crc32, r.doc_tokens) == (brute.crc(ids), len(want[r.doc_id]))
            got[r.doc_id].append((r.start, r.length))
            seqs[r.sequence_id].append((r.offset, r.length))
        for i, ids in want.items():
            at = 0
            for start, n in sorted(got[i]):
                assert start == at
                at += n
            assert at == len(ids)
        for put in seqs.values():
            at = 0
            for off, n in sorted(put):
                assert off == at
                at += n
            assert at <= window
        total = sum(map(len, want.values()))
        assert len(seqs) <= total // window + 1 + len(rows) // 10


def test_plan_is_tight():
    counts = {1500: 10, 548: 7, 500: 9, 48: 9, 3: 4}
    used = packing.plan(counts, 2048)
    assert sum(t for t, _ in used) == -(-sum(n * c for n, c in counts.items()) // 2048)
    assert all(sum(n * k for n, k in u.items()) <= 2048 for _, u in used)


if __name__ == "__main__":
    os._exit(pytest.main([__file__]))
