"""Queries of the text operators with their production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, vocabulary
from . import bpe, collocations, common, decontaminate, jaccard, langid, merkle, packing, resample, sentences, shards, suffix, toxicity, winnow
from . import pipeline as stages


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.resample(documents(spark, sf_dir), common.read(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_ngrams", "log_weight", "sample_key", "selected")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard.jaccard_classes(documents(spark, sf_dir))
    return got.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentences.dedup_sentences(documents(spark, sf_dir), keep=["doc_id"])
    return got.select("row.doc_id", "n_sentences", "n_removed", F.array_join("removed", ",").alias("removed"), "kept_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(documents(spark, sf_dir), common.read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shards.shard(documents(spark, sf_dir))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.dedup_substrings(documents(spark, sf_dir), keep=["doc_id"])
    return got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), common.read(spark, sf_dir, "labels"))


def op8_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), added=True)


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(documents(spark, sf_dir))


def op11_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    got = bpe.decode(bpe.encode(documents(spark, sf_dir), path, keep=["doc_id"]), path)
    digits = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return got.select("row.doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fractal_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower).otherwise(F.col("text"))
    return merkle.manifest(documents(spark, sf_dir), altered={"text": tampered})


def op13_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = collocations.best(collocations.collocations(documents(spark, sf_dir)), 2000)
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_importance_resampling, op2_ngram_jaccard_join, op3_sentence_span_dedup, op4_benchmark_decontamination, op5_hypergeometric_shuffle, op6_suffix_dedup, op7_toxicity_machine, op8_minimum_slack_packing, op9_kneser_ney_language, op10_winnowing, op11_pair_index_bpe, op12_fractal_manifest, op13_trie_collocations, pipeline)}

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = f"regexp_extract_all({_LOWER.format(x='text')}, '[^\\x20\\x09-\\x0D]+')"
_ITEM_WORDS = f"regexp_extract_all({_LOWER.format(x='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _leaf_sql(text: str) -> str:
    """A leaf's digest; strlen counts bytes."""
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the id's decimal digits by its bits, as the dialect has no such function.
_CRC = "xor(CAST(list_reduce([4294967295] || list_transform(range(0, 8 * strlen(CAST(doc_id AS VARCHAR))), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INT), 1)) ELSE 0 END), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END) AS BIGINT), 4294967295)"
_SIDES = "coalesce(string_agg(d, '') OVER (PARTITION BY {run} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(d, '') OVER (PARTITION BY {run} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_BLANK_WORDS}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM o JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS d, doc_id AS x FROM documents UNION SELECT r.d, e.v FROM r JOIN e ON r.x = e.u WHERE e.v < r.d OR e.v > r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(x) FROM r WHERE d = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)""",
    "op4_benchmark_decontamination": f"""WITH w AS (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, l, array_to_string(ws[i : i + l - 1], ' ') AS s FROM (SELECT item, ws, least(len(ws), 10) AS l, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
pos AS (SELECT doc_id, l, i, array_to_string(ws[i : i + l - 1], ' ') AS s FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w, (SELECT DISTINCT l FROM win) WHERE len(ws) >= l)),
hit AS (SELECT doc_id, i, l, item FROM pos JOIN win USING (l, s)), hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY ALL),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY ALL)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op12_fractal_manifest": f"""WITH RECURSIVE x AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN {_LOWER.format(x='text')} ELSE text END AS found FROM documents),
l AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql('found')} AS found, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM x),
t AS (SELECT 0 AS lvl, source, pos, leaf AS d, n FROM l UNION ALL SELECT lvl + 1, source, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY lvl, source, pos // 16, n),
s AS (SELECT source, d AS subroot, lvl AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
v AS (SELECT 0 AS lvl, pos, subroot AS d, n FROM s UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16 FROM v WHERE n > 1 GROUP BY lvl, pos // 16, n),
a AS (SELECT lvl, coalesce(source, '') AS k, source IS NULL AS none, pos, {_SIDES.format(run='lvl, source, pos // 16')} FROM t WHERE n > 1), b AS (SELECT lvl, pos, {_SIDES.format(run='lvl, pos // 16')} FROM v WHERE n > 1),
f AS (SELECT doc_id, source, leaf, 0 AS lvl, pos, found AS d, '' AS proof FROM l UNION ALL SELECT doc_id, source, leaf, f.lvl + 1, f.pos // 16, sha256(pre || d || post), proof || pre || post FROM f JOIN a ON f.lvl = a.lvl AND coalesce(source, '') = k AND (source IS NULL) = none AND f.pos = a.pos),
g AS (SELECT doc_id, f.source, leaf, 0 AS lvl, s.pos, d, proof, subroot FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source AND lvl = top UNION ALL SELECT doc_id, source, leaf, g.lvl + 1, g.pos // 16, sha256(pre || d || post), proof || pre || post, subroot FROM g JOIN b ON g.lvl = b.lvl AND g.pos = b.pos)
SELECT doc_id, leaf, subroot, v.d AS root, sha256(proof) AS proof_sha256, g.d AS folded_root, g.d = v.d AS verified FROM g JOIN v ON v.n = 1 AND g.lvl = v.lvl""",
    "op13_trie_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format(x="coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p), u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
t1 AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM u GROUP BY ALL), t2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM u WHERE i < len(ws) GROUP BY ALL), t3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM u WHERE i < len(ws) - 1 GROUP BY ALL HAVING count(*) >= 10),
k AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM t3 UNION ALL SELECT lang, w2, w3, f FROM t3) GROUP BY ALL),
c AS (SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, y.f AS l, z.f AS r, 1 AS cutat FROM t2 x JOIN t1 y ON x.lang = y.lang AND x.w1 = y.w1 JOIN t1 z ON x.lang = z.lang AND x.w2 = z.w1 LEFT JOIN k ON x.lang = k.lang AND x.w1 = k.w1 AND x.w2 = k.w2 WHERE x.f >= 10 AND (longer IS NULL OR 100 * longer < 50 * x.f)
UNION ALL SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, y.f, z.f, 1 FROM t3 x JOIN t1 y ON x.lang = y.lang AND x.w1 = y.w1 JOIN t2 z ON x.lang = z.lang AND x.w2 = z.w1 AND x.w3 = z.w2
UNION ALL SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, y.f, z.f, 2 FROM t3 x JOIN t2 y ON x.lang = y.lang AND x.w1 = y.w1 AND x.w2 = y.w2 JOIN t1 z ON x.lang = z.lang AND x.w3 = z.w1),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cutat) AS j FROM s),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o WHERE j = 1), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000""",
}
