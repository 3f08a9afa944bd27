"""Passages without blanks share fingerprints at every offset."""

from regioscope.llm import winnow

HAN = "".join(chr(0x4E00 + i * i * 37 % 5000) for i in range(100))
CODE = "".join("abcdefghijklmnopqrstuvwxyz0123456789"[(i * i * i + i * 5) % 36] for i in range(100))


def test_unspaced_passage_at_any_offset(spark):
    rows = []
    for n, passage in enumerate((HAN, CODE)):
        for off in range(9):
            rows.append((n * 100 + off, "#%&*+=@!?"[:off] + passage + "$" * (off % 3)))
        rows.append((n * 100 + 50, passage[:20] + passage[21:]))
        rows.append((n * 100 + 51, "lead in with words " + passage[20:90]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fp = {r.doc_id: set(r.h) for r in winnow.fingerprints(df, "text", "fp", 32, 16).select("doc_id", winnow.hashes("fp").alias("h")).collect()}
    for n in (0, 100):
        assert all(fp[n] & fp[n + d] for d in (*range(1, 9), 50, 51))
    assert not fp[0] & fp[100]
