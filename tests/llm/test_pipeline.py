"""The pipeline stage by stage against brute force, and on odd and empty documents."""

import re

import brute
import corpus_pipeline
from regioscope.llm import common, queries, resample

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    docs = common.read(spark, SF, "documents")
    a = common.cut(stage["quality"](spark, docs, SF))
    want = {r.doc_id for r in resample.resample(docs, common.read(spark, SF, "labels")).where("selected").collect()}
    assert set(rows(a)) == want and a.columns == docs.columns

    b = common.cut(stage["near_duplicates"](spark, a, SF))
    texts = [(i, r.text) for i, r in rows(a).items()]
    assert set(rows(b)) == {c for _, c in brute.jaccard(texts).values()} and b.columns == docs.columns

    c = common.cut(stage["suffix_dedup"](spark, b, SF))
    kept = {i: r.text for i, r in rows(c).items()}
    judged = brute.substrings([(i, r.text) for i, r in rows(b).items()])
    for i, r in rows(b).items():
        assert (kept[i] == r.text) == (judged[i][1] == 0)
        assert len(kept[i].encode()) <= judged[i][0] - judged[i][1]  # cut characters go as a whole
        assert rows(c)[i].n_chars == (r.n_chars if kept[i] == r.text else len(kept[i]))

    d = common.cut(stage["decontamination"](spark, c, SF))
    items = [(r.item_id, r.text) for r in common.read(spark, SF, "benchmark").collect()]
    hit = {i for i, x in brute.decontaminate(list(kept.items()), items).items() if x[1]}
    clean = {i: r.text for i, r in rows(d).items()}
    assert set(clean) == set(kept) and {i for i in clean if clean[i] != kept[i]} == hit
    for i in hit:
        n = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(brute.LOWER)))
        assert n(clean[i]) < n(kept[i])

    e = stage["packing"](spark, d, SF).collect()
    assert {r.doc_id for r in e} == set(clean)
    used = {}
    for r in e:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for put in used.values():
        at = 0
        for off, n in sorted(put):
            assert off == at
            at += n
        assert at <= 2048


def test_odd_and_empty_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, 3), (2, "a b", None, None, 3), (3, "word " * 3000, "en", "s", 15000)]
    for name, data in (("odd", odd), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(at)).collect()
        assert (len(got) == 0) == (not data)
        for q in ("op1_importance_resampling", "op3_sentence_span_dedup", "op5_hypergeometric_shuffle", "op10_winnowing"):
            assert queries.QUERIES[q](spark, str(at)).count() == len(data)
