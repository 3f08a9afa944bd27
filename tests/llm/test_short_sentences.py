"""Repeated passages of short lines, and texts without punctuation."""

import brute
from regioscope.llm import common, queries

LINES = [" ".join(f"l{k}w{j}" for j in range(7)) for k in range(8)]
MIXED = [" ".join(f"m{k}w{j}" for j in range(n)) for k, n in enumerate((15, 1, 1, 3, 14, 1, 2))]
LONE = " ".join(f"u{j}" for j in range(70))
TEXTS = [
    "Own lead one.\n" + "\n".join(LINES) + "\nown tail one.", "Other lead.\n" + "\n".join(LINES) + "\nother tail.",
    "A b.\n" + "\n".join(MIXED) + "\nc d.", "E f.\n" + "\n".join(MIXED) + "\ng h.", LONE, LONE, "Before. " + LONE + ". After.",
    " ".join(f"v{j}" for j in range(16)), " ".join(f"v{j}" for j in range(16)), "Too short. Here so.", "too short! here so", "one alone", "one alone", None, "", "\n".join(LINES * 2),
]


def test_short_lines_and_lone_sentences(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_sentences, r.removed) for r in queries.QUERIES["op3_sentence_span_dedup"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(brute.sentences(TEXTS)))
    assert got[1][1] == "1,2,3,4,5,6,7,8" and got[3][1] == "1,2,3,4,5,6,7" and got[5][1] == "0" and got[6][1] == "1" and got[8][1] == "0" and got[10][1] == "0,1" and got[12][1] == ""


def test_table_against_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in common.read(spark, sf, "documents").select("doc_id", "text").collect())
    want = dict(zip([i for i, _ in rows], brute.sentences([t for _, t in rows]), strict=True))
    assert {r.doc_id: (r.n_sentences, r.removed) for r in queries.QUERIES["op3_sentence_span_dedup"](spark, sf).collect()} == want
