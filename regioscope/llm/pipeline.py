"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

quality (importance resampling; rejected documents go), near duplicates (one document of each class
stays, the one of the smallest id, where null is the smallest; equal rows and copies without an id are
copies like others; texts without words are in no class, but equal in id and text they are one), substring dedup (repeated bytes go), benchmark decontamination
(hit words go), packing (pieces of token sequences). All stages but the last return the columns of
documents; a stage that changes a text sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, jaccard, packing, resample, suffix

#: SQL can't express the stages (random sampling, a public tokenizer); tests hold each against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """Each row as a struct, so that no column of documents can clash with one of a stage."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects.

    A text without words (null, empty, blank) has weight 0 and is judged by it; rows equal in id and
    text stay or go together, also without an id; ties at the last place stay; without usable
    labels, and in an empty table, everything stays.
    """
    common.small_batches(spark)
    got = resample.resample(docs.select("doc_id", "text"), common.read(spark, sf_dir, "labels"))
    kept = got.where("selected").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct()
    doc_id = F.col("row.doc_id").cast("bigint")
    rows = _apart(docs).withColumns({"doc_id": doc_id, "mark": F.xxhash64(doc_id, F.coalesce("row.text", F.lit("")))})
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates.

    The row of the smallest id stays (no id is the smallest), among equal ids the one of the smaller text
    hash; equal rows are one, with or without an id; texts without words are in no class, but rows
    equal in id and text are one; repeated ids with different texts are rows of their own; an empty
    table gives none.
    """
    common.small_batches(spark)
    rows = common.cut(_apart(docs).withColumn("at", F.monotonically_increasing_id()))  # written, so places stay
    got = jaccard.jaccard_classes(rows.select("at", "row.text"), key="at").select(F.col("doc").alias("at"), "cls")
    named = rows.select("at", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(jaccard.LEAST)).alias("id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("mark"))
    bare = F.col("cls").isNull()
    classes = got.join(named, "at").groupBy("cls", F.when(bare, F.col("id")).alias("bare_id"), F.when(bare, F.col("mark")).alias("bare_mark"))
    kept = classes.agg(F.min(F.struct("id", "mark", "at")).alias("first")).select(F.col("first.at").alias("at"))
    return rows.join(kept, "at", "left_semi").select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of 100-byte strings that start earlier in the corpus.

    A cut character goes as a whole; null and short texts stay as they are; a text that repeats from end
    to end becomes empty; rows equal in id and text are one document; an empty table gives none.
    """
    common.small_batches(spark)
    got = suffix.dedup_substrings(docs, cut_text=True)
    return _with_text(docs, got, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words inside occurrences of benchmark windows.

    Null texts and texts without a hit stay as they are; repeated rows are judged each; null items are
    ignored; very long texts are scanned whole; an empty benchmark hits nothing.
    """
    common.small_batches(spark)
    got = decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"), cut_text=True)
    return _with_text(docs, got, F.coalesce("clean_text", "row.text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places in packed sequences.

    Null and empty texts have just the end id; repeated rows are packed each; a very long text fills
    many sequences; an empty table gives none.
    """
    common.small_batches(spark)
    return packing.pack(docs, common.vocabulary(), added=True)


def _with_text(docs: DataFrame, got: DataFrame, text) -> DataFrame:
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(text.eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return got.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("suffix_dedup", substrings), ("decontamination", benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself is deleted when its result is written; the last stage's files stay, as its result reads them."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        began = common.mark()
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut(docs)
            common.release_since(began, docs)
            common.release(before)
    return docs
