"""Null and repeated ids, equal rows, clashing column names and bytes that are not UTF-8."""

from collections import Counter

import brute
import pytest
from regioscope.llm import decontaminate, jaccard, packing, queries, suffix
from tokenizers import Tokenizer

A, B, C = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
ROWS = [(None, A), (None, B), (3, A), (4, B), (5, C), (5, A + " more"), (5, C), (6, None), (6, ""), (None, None)]


def test_null_ids_link_nothing(spark):
    got = jaccard.jaccard_classes(spark.createDataFrame(ROWS, "doc_id bigint, text string")).collect()
    assert Counter((r.doc, r.n_shingles, r.component) for r in got) == Counter(
        [(None, 56, 3), (None, 56, 4), (3, 56, 3), (4, 56, 4), (5, 56, 5), (5, 57, 3), (5, 56, 5), (6, 0, 6), (6, 0, 6), (None, 0, None)]
    )


@pytest.mark.parametrize("name", ["_id", "_mark", "_row", "row", "items", "mark", "doc", "text_", "ghost"])
def test_clashing_names(spark, name):
    df = spark.createDataFrame([(i, t, f"x{k}") for k, (i, t) in enumerate(ROWS)], f"doc_id bigint, text string, `{name}` string")
    bench = spark.createDataFrame([(1, "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9")], "item_id bigint, text string")
    assert suffix.dedup_substrings(df, keep=[name]).count() == len(ROWS)
    assert sum(r.n_hit for r in decontaminate.decontaminate(df, bench, keep=[name]).collect()) == 30


def test_ids_of_bytes_that_are_not_text(spark):
    raw = [b"plain text", b"bad \xff\xfe byte", b"cut \xe6\x97", b"\x80", "é日本".encode()]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "doc_id bigint, b binary").selectExpr("doc_id", "cast(b as string) text")
    tok = Tokenizer.from_file(queries.vocabulary())
    want = {i: [*tok.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, 1] for i, x in enumerate(raw)}
    got = {r.doc_id: (r.ids_crc32, r.doc_tokens) for r in packing.pack(df, queries.vocabulary(), added=True).collect()}
    assert got == {i: (brute.crc(x), len(x)) for i, x in want.items()}


def test_long_text(spark):
    long = " ".join(f"w{i * 7919 % 1000003}" for i in range(400_000))  # over two megabytes: whole pieces and chunks
    rows = [(1, long), (2, "lead " + long[1_000_000:1_000_400] + " tail"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.row.doc_id: (r.n_bytes, r.n_removed) for r in suffix.dedup_substrings(df, keep=["doc_id"]).collect()}
    assert got[1] == (len(long), 0) and got[3] == (0, 0) and 400 <= got[2][1] <= 402
    tok = Tokenizer.from_file(queries.vocabulary())
    pieces = [r for r in packing.pack(df, queries.vocabulary(), added=True, with_ids=True).collect() if r.doc_id == 1]
    assert [x for r in sorted(pieces, key=lambda r: r.start) for x in r.ids] == [*tok.encode(long, add_special_tokens=False).ids, 1]
