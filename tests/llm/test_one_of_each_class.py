"""One row of each class stays, whatever ids its copies have."""

from collections import Counter

import corpus_pipeline

A, B, C, D = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
ROWS = [(1, A), (1, A), (2, A), (None, B), (None, B), (5, B), (None, C), (7, D), (7, C + " more"), (8, D), (9, ""), (9, ""), (10, ""), (None, None), (None, None)]


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, A), (None, B), (None, C), (7, D), (9, ""), (10, ""), (None, None)])


def test_extra_columns_with_names_of_any_kind(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ["_id", "_mark", "_m", "_row", "_kept", "at", "mark", "cls", "row", "items", "bits", "sha", "whole"]
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in names})
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[n] == n for r in rows for n in names)
        if name == "near_duplicates":
            assert Counter((r.doc_id, r.text) for r in rows) == Counter([(1, A), (None, B), (None, C), (7, D), (9, ""), (10, ""), (None, None)])
