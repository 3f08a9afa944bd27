"""Rows that stand twice, with equal id and text, are one document."""

import brute
import pytest
import pyarrow as pa
from regioscope.llm import suffix

PASSAGE = " ".join(f"shared{i * 37 % 101}x{i}" for i in range(40))
FIRST = "before it stands this, " + PASSAGE + " and after it that"
ROWS = [(1, FIRST), (2, "other lead " + PASSAGE + " other tail"), (3, "x" * 90)]


def test_repeated_row_keeps_the_first_occurrence(spark, monkeypatch):
    want = brute.substrings(ROWS)
    assert want[1][1] == 0 < want[2][1]
    for heavy in (suffix.HEAVY, 0):
        monkeypatch.setattr(suffix, "HEAVY", heavy)
        for times in (2, 5):
            df = spark.createDataFrame([ROWS[0]] * times + ROWS[1:], "doc_id bigint, text string").coalesce(1)
            got = suffix.dedup_substrings(df, keep=["doc_id"]).collect()
            assert len(got) == times + 2
            assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.row.doc_id] for r in got)


def test_a_context_met_twice_is_not_a_repeat_of_itself():
    row = {"doc": 1, "mark": 5, "text": FIRST, "packed": [(60 << 14) | (40 << 7) | 30], "hs": [9], "heavy": [0]}
    batch = pa.RecordBatch.from_pylist([row, row, row | {"doc": 2}])
    out = pa.Table.from_batches(suffix._contexts(100)([batch])).to_pylist()
    assert [r["doc"] for r in out if r["ctx"] is None] == [2]


@pytest.mark.parametrize("very", [0, 3])
def test_substrings_window_by_window(spark, monkeypatch, very):
    passage = " ".join(f"word{i * 37 % 101}" for i in range(60))
    rows = [(i, f"{chr(97 + i % 26) * (i % 9)}{passage}{chr(65 + i % 26) * (i % 5)} own {i} " * 1) for i in range(80)]
    monkeypatch.setattr(suffix, "HEAVY", 0)
    monkeypatch.setattr(suffix, "VERY_HEAVY", very)
    got = suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=["doc_id"]).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.substrings(rows)


@pytest.mark.parametrize("step", [0, 1, 8])
def test_settled_contexts_are_one_range_a_document(step):
    passage = "".join(chr(97 + i * i % 23) for i in range(400))
    packed = [(at << 14) | (40 << 7) | 30 for at in range(60, 290, 31)]  # windows that follow each other without a gap
    rows = [{"doc": i, "mark": i, "text": passage, "packed": packed, "hs": list(range(len(packed))), "heavy": [step] * len(packed)} for i in range(200)]
    out = pa.Table.from_batches(suffix._contexts(100)([pa.RecordBatch.from_pylist(rows)])).to_pylist()
    bare = [r for r in out if r["ctx"] is None]
    assert len({r["doc"] for r in bare}) == 199 and 0 not in {r["doc"] for r in bare}
    assert len(bare) <= 200 and max(r["part"] for r in bare) == 7 * 31 + 130
