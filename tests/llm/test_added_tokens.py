"""Added tokens in a text: ids equal those of ``tokenizers`` at its defaults."""

import brute
import corpus_pipeline
import pytest
from regioscope.llm import queries
from tokenizers import Tokenizer

E = "<|endoftext|>"
TEXTS = ["a " + E + " b", E, E + E, "x" + E + "'s y", "a  " + E + "\n\nb", E + "\n", "a\n" + E + " c d", "<|endof", "text|>", E[:-1], "é" + E + "日本", "<" + E + ">", "plain text", None, "1" + E + "2 " + E + "."]


@pytest.mark.parametrize("whole", ["query", "pipeline"])
def test_ids_of_added_tokens(spark, tmp_path, whole):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.documents(spark, str(tmp_path))
    got = queries.QUERIES["op8_minimum_slack_packing"](spark, str(tmp_path)) if whole == "query" else corpus_pipeline.pack(spark, docs, str(tmp_path))
    tok = Tokenizer.from_file(queries.vocabulary())
    assert tok.encode(TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: (r.ids_crc32, r.doc_tokens) for r in got.collect()} == {i: (brute.crc(x), len(x)) for i, x in want.items()}
