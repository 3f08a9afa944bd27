"""Quality selection by importance resampling over hashed n-gram generative models.

Words and word pairs of each text are hashed to ``bins``. The raw model is the bag of all documents,
the target model that of a bounded sample of documents labelled as good. A document's log weight is
the sum over its n-grams of log p_target - log p_raw. Sampling without replacement in proportion to
the weights is the Gumbel top-k: to each log weight, divided by ``temperature`` (1: the weights
themselves), a Gumbel variate is added (from a hash of id and text, so a rerun draws the same), and
the k largest are kept.

k is the number of documents whose log weight reaches the level that best separates the good from
the bad among the sampled labels, so it follows the corpus. The k-th key is found by counting in
steps of 16 bits over the keys' order-preserving bits: four passes over two narrow columns, no global
sort, 65,536 counters at most on the driver.

The labelled sample is bounded by ``most_labels`` (a parameter); counts of the raw model, weights,
k and selection cover all documents.

Edge cases: a text without words (null, empty, blank) has log weight 0; equal keys are ordered by
the row hash, and rows equal in id and text are kept or dropped together (k is then passed by those
ties); without usable labels everything is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut


def ngram_bins(data: np.ndarray, offs: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of every word and every pair of neighbouring words, by document: values and offsets."""
    s, e, at = K.words(data, offs, K.BLANK)
    h = K.hash_spans(data, s, e)
    pair, to = K.runs(h, at, 2, False)
    n1, n2 = np.diff(at), np.diff(to)
    off = np.concatenate(([0], np.cumsum(n1 + n2)))
    out = np.empty(off[-1], np.int64)
    mask = np.uint64(bins - 1)
    # document d: its words first, then its pairs
    out[np.repeat(off[:-1] - at[:-1], n1) + np.arange(len(h))] = (h & mask).astype(np.int64)
    out[np.repeat(off[:-1] + n1 - to[:-1], n2) + np.arange(len(pair))] = ((pair >> np.uint64(13)) & mask).astype(np.int64)
    return out, off


def log_weights(docs: DataFrame, good: DataFrame, *, key: str = "doc_id", text: str = "text", bins: int = 1 << 16, smooth: float = 0.5) -> tuple[DataFrame, list]:
    """Rows (doc_id, mark, n_ngrams, log_weight) of all docs; ``good`` maps doc_id to 1 or 0 for a bounded sample."""
    spark = docs.sparkSession
    labels = {r.doc_id: r.quality for r in good.collect()}
    shared = spark.sparkContext.broadcast(labels)

    def count(source):
        raw, target = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        label = shared.value
        for data, offs, more in K.batches(source, "text", "doc_id"):
            b, off = ngram_bins(data, offs, bins)
            raw += np.bincount(b, minlength=bins)
            mine = np.array([label.get(i) == 1 for i in more["doc_id"].to_pylist()], bool)
            if mine.any():
                target += np.bincount(b[np.repeat(mine, np.diff(off))], minlength=bins)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bin", "raw", "target"])

    narrow = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    got = narrow.mapInArrow(count, "bin bigint, raw bigint, target bigint").groupBy("bin").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full(bins, smooth), np.full(bins, smooth)
    for b, x, y in got:
        raw[b] += x
        target[b] += y
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if not any(v == 1 for v in labels.values()):
        ratio[:] = 0
    model = spark.sparkContext.broadcast(ratio)

    def weigh(source):
        r = model.value
        for data, offs, more in K.batches(source, "text", "doc_id", "mark"):
            b, off = ngram_bins(data, offs, bins)
            c = np.concatenate((r[b], [0.0]))
            n = np.diff(off)
            w = np.where(n > 0, np.add.reduceat(c, off[:-1]) if len(n) else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([more["doc_id"], more["mark"], pa.array(n), pa.array(np.round(w, 6))], ["doc_id", "mark", "n_ngrams", "log_weight"])

    marked = narrow.withColumn("mark", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return marked.mapInArrow(weigh, "doc_id bigint, mark bigint, n_ngrams bigint, log_weight double"), labels


def kth_largest(df: DataFrame, bits: str, k: int) -> int | None:
    """The k-th largest value of a long column (as unsigned bits), by counting 16 bits at a time."""
    if k <= 0:
        return None
    prefix, rest = 0, k
    for step in range(4):
        shift = 48 - 16 * step
        part = df if step == 0 else df.where(F.shiftrightunsigned(bits, shift + 16) == prefix)
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")
        counts = sorted(part.groupBy(digit).count().collect(), reverse=True)
        for d, n in counts:
            if rest <= n:
                prefix = prefix << 16 | d
                break
            rest -= n
        else:
            return None
    return prefix


def resample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", quality: str = "quality", bins: int = 1 << 16, temperature: float = 1.0, most_labels: int = 20_000, seed: int = 11) -> DataFrame:
    """doc_id, mark (hash of id and text), n_ngrams, log_weight, sample_key, selected for every row of docs."""
    sample = (
        labels.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labels)
    )
    scored, known = log_weights(docs, sample, key=key, text=text, bins=bins)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mark"), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    scored = cut(scored.withColumn("sample_key", F.round(F.col("log_weight") / F.lit(temperature) - F.log(-F.log(u)), 9)))
    spark = docs.sparkSession
    lab = spark.createDataFrame(list(known.items()) or [(0, None)], "doc_id bigint, quality int")
    marks = scored.join(F.broadcast(lab), "doc_id").where("quality is not null").select("log_weight", "quality").collect()
    level = best_level(np.array([m[0] for m in marks]), np.array([m[1] for m in marks]))
    k = scored.where(F.col("log_weight") >= F.lit(level)).count()
    fixed = F.round(F.col("sample_key") * F.lit(1e6)).cast("bigint")  # six decimals; |key| < 9e12
    ordered = scored.withColumn("bits", fixed.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")))
    least = kth_largest(ordered, "bits", k)
    if least is None:
        return scored.withColumn("selected", F.lit(False))
    least = least - (1 << 63)
    return scored.withColumn("selected", fixed >= F.lit(least).cast("bigint"))


def best_level(weight: np.ndarray, good: np.ndarray) -> float:
    """The level with the least sum of the two error rates; -inf without labels of both kinds. A good row lost counts tenfold."""
    if not len(weight) or good.min() == good.max():
        return float("-inf")
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    passed = 1 - np.concatenate(([0], np.cumsum(1 - g))) / (1 - g).sum()
    edge = np.concatenate(([True], w[1:] > w[:-1], [True]))
    cost = np.where(edge, 10 * lost + passed, np.inf)
    i = int(np.argmin(cost))
    if i == 0:
        return float(w[0]) - 1
    if i == len(w):
        return float(w[-1]) + 1
    return float(w[i] + w[i - 1]) / 2
