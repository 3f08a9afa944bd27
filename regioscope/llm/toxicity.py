"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased word hashed to 2**18 bins. score = sigmoid(w0 + sum w_i x_i +
sum_{i<j} <v_i, v_j> x_i x_j): the pair part learns that terms are toxic together (an insult with a
second one, or with a group mention) where each alone is not. x_i = 1 + ln(count).

Fitting uses at most ``most_labels`` labelled training rows (chosen by hash; a parameter); of their texts
only distinct bins with counts reach the driver. Bins are screened by their document frequencies and by
those of pairs, so a term that tells only beside another one is kept too: alone, by the log-odds z-value or
the signed root of the likelihood ratio (which a term of toxic texts alone passes too); in a pair, by that
root for texts that hold both, where it exceeds both terms' own (judged on ``pair_labels`` of the rows). The machine is fitted to the screened bins by
Adam with logistic loss, its level is set on clean training rows that it has not seen (``levelled``), and the fitted arrays are broadcast. Every document is scored over its whole text.

Edge cases: a text without screened terms (null, empty) scores sigmoid(w0); without labels of both
kinds every score is the training share or 0.5; repeated rows score alike; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

BINS = 1 << 18


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every word, and document offsets."""
    data = K.LOWER[data]
    s, e, at = K.words(data, offs, K.ITEM_GAP)
    return (K.hash_spans(data, s, e) & np.uint64(BINS - 1)).astype(np.int64), at


def counted(doc: np.ndarray, index: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, index) in order, with 1 + ln(count)."""
    pair, n = np.unique(doc * width + index, return_counts=True)
    return pair // width, pair % width, 1 + np.log(n)


class Machine:
    """Screened bins (``at``: bin to row or -1), bias, linear weights and factors."""

    def __init__(self, at, bias, w, v):
        self.at, self.bias, self.w, self.v = at, bias, w, v

    def score(self, bins: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        doc = np.repeat(np.arange(n), np.diff(offs))
        row = self.at[bins]
        on = row >= 0
        z = np.full(n, self.bias)
        if on.any():
            d, i, x = counted(doc[on], row[on], len(self.w))
            z += np.bincount(d, self.w[i] * x, n)
            for f in range(self.v.shape[1]):
                vx = self.v[i, f] * x
                z += 0.5 * (np.bincount(d, vx, n) ** 2 - np.bincount(d, vx * vx, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ratio_root(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Root of the likelihood ratio statistic of each term's two document frequencies."""
    both = toxic + clean
    part = lambda k, n, m: k * np.log(np.where(k > 0, k, 1) * (n1 + n0) / np.where(k > 0, n * m, n1 + n0))
    seen, rest = np.maximum(both, 1), np.maximum(n1 + n0 - both, 1)
    g = part(toxic, seen, n1) + part(clean, seen, n0) + part(n1 - toxic, rest, n1) + part(n0 - clean, rest, n0)
    return np.sqrt(2 * np.maximum(g, 0))


def frequencies(bins: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Document frequency of every bin among clean and toxic texts."""
    freq = np.zeros((2, BINS))
    for b, t in zip(bins, y, strict=True):
        freq[int(t), np.unique(b)] += 1
    return freq


def _pairs(bins: list[np.ndarray], often: np.ndarray, most: int = 1 << 19):
    """Pairs (x < z) of distinct bins that texts hold together, as x * BINS + z, in portions of about ``most``."""
    held, size = [], 0
    for b in bins:
        b = np.unique(b[often[b]])
        for a in range(0, len(b) - 1, 512):
            n = len(b) - 1 - np.arange(a, min(a + 512, len(b) - 1))  # partners to the right
            x = np.repeat(np.arange(a, a + len(n)), n)
            z = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            held.append(b[x] * BINS + b[z])
            size += len(x)
            if size >= most:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def paired(bins: list[np.ndarray], y: np.ndarray, least: float = 6.0, least_docs: int = 8, buckets: int = 1 << 24) -> np.ndarray:
    """Bins of pairs that toxic texts hold together, where the pair tells more than its terms do.

    Pairs of toxic texts are counted by hash bucket, then by name where a bucket holds ``least_docs``, and stay
    while they could tell enough if no clean text had them. What is left is counted exactly on bit sets of
    the texts that hold each term. Terms in over half of all texts pair with everything and are left out.
    """
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    freq = frequencies(bins, y)
    alone = ratio_root(freq[1], freq[0], n1, n0)
    often = (freq.sum(0) >= least_docs) & (freq.sum(0) <= 0.6 * len(bins))
    toxic = [b for b, t in zip(bins, y, strict=True) if t == 1]
    seen = np.zeros(buckets, np.uint16)
    bucket = lambda pair: (K.mix(pair.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)
    for pair in _pairs(toxic, often):
        np.add.at(seen, bucket(pair), 1)
    parts = [np.unique(pair[seen[bucket(pair)] >= least_docs], return_counts=True) for pair in _pairs(toxic, often)]
    pairs, back = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, _ in parts)]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([np.zeros(0), *(n for _, n in parts)]), len(pairs)).astype(np.int64)
    x, z = pairs // BINS, pairs % BINS
    need = np.maximum(least, 1 + np.maximum(alone[x], alone[z]))
    can = (counts >= least_docs) & (ratio_root(counts.astype(float), np.zeros(len(counts)), n1, n0) >= need)
    x, z, counts, need = x[can], z[can], counts[can], need[can]
    terms_, back = np.unique(np.concatenate((x, z)), return_inverse=True)
    if not len(terms_):
        return terms_
    row = np.full(BINS, -1)
    row[terms_] = np.arange(len(terms_))
    clean = [b for b, t in zip(bins, y, strict=True) if t == 0]
    words = -(-len(clean) // 64)
    bits = np.zeros((len(terms_), words), np.uint64)
    for d, b in enumerate(clean):
        r = row[b]
        bits[r[r >= 0], d // 64] |= np.uint64(1 << d % 64)
    i, j = back[: len(x)], back[len(x) :]
    both = np.concatenate([np.bitwise_count(bits[i[k : k + 4096]] & bits[j[k : k + 4096]]).sum(1) for k in range(0, len(i), 4096)]).astype(float)
    on = (ratio_root(counts.astype(float), both, n1, n0) >= need) & (counts * n0 > both * n1)
    return np.unique(np.concatenate((x[on], z[on])))


def fit(bins: list[np.ndarray], y: np.ndarray, *, counts: list[np.ndarray] | None = None, factors: int = 8, least_z: float = 4.0, pair_labels: int = 2000, epochs: int = 40, rate: float = 0.03, l2: float = 1e-4, seed: int = 3) -> Machine:
    at = np.full(BINS, -1, np.int64)
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    flat = Machine(at, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, factors)))
    if not len(y) or y.min() == y.max():
        return flat
    freq = frequencies(bins, y)
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    a, c = freq[1] + 0.5, freq[0] + 0.5
    z = (np.log(a / (n1 - freq[1] + 0.5)) - np.log(c / (n0 - freq[0] + 0.5))) / np.sqrt(1 / a + 1 / c + 1 / (n1 - freq[1] + 0.5) + 1 / (n0 - freq[0] + 0.5))
    strength = np.where(freq.sum(0) > 0, np.maximum(np.abs(z), ratio_root(freq[1], freq[0], n1, n0)), 0)
    some = np.sort(np.random.default_rng(seed).permutation(len(bins))[:pair_labels])
    pick = np.union1d(np.flatnonzero(strength >= least_z), paired([bins[k] for k in some], y[some]))
    if not len(pick):
        return flat
    at[pick] = np.arange(len(pick))
    m = len(pick)
    doc = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    row = at[np.concatenate(bins)] if len(doc) else np.zeros(0, np.int64)
    on = row >= 0
    d, i, x = counted(doc[on], row[on], m) if counts is None else (doc[on], row[on], 1 + np.log(np.concatenate(counts)[on]))
    offs = np.searchsorted(d, np.arange(len(bins) + 1))
    rng = np.random.default_rng(seed)
    p = [np.array([flat.bias]), np.zeros(m), rng.normal(0, 0.05, (m, factors))]
    mom, var, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        step_rate = rate * (1 - epoch / epochs)
        order = rng.permutation(len(bins))
        for part in np.array_split(order, max(1, len(order) // 512)):
            part = np.sort(part)
            cnt = offs[part + 1] - offs[part]
            e = np.repeat(offs[part] - np.concatenate(([0], np.cumsum(cnt)[:-1])), cnt) + np.arange(cnt.sum())
            dd, ii, xx = np.repeat(np.arange(len(part)), cnt), i[e], x[e]
            vx = p[2][ii] * xx[:, None]
            s = np.stack([np.bincount(dd, vx[:, f], len(part)) for f in range(factors)], 1)
            q = np.stack([np.bincount(dd, vx[:, f] ** 2, len(part)) for f in range(factors)], 1)
            zed = p[0][0] + np.bincount(dd, p[1][ii] * xx, len(part)) + 0.5 * (s**2 - q).sum(1)
            err = (1 / (1 + np.exp(-np.clip(zed, -30, 30))) - y[part]) / len(part)
            gw = np.bincount(ii, err[dd] * xx, m)
            gv_rows = (err[dd] * xx)[:, None] * (s[dd] - vx)
            gv = np.stack([np.bincount(ii, gv_rows[:, f], m) for f in range(factors)], 1)
            t += 1
            for k, g in enumerate((np.array([err.sum()]), gw + l2 * p[1], gv + l2 * p[2])):
                mom[k] += 0.1 * (g - mom[k])
                var[k] += 0.01 * (g * g - var[k])
                p[k] = p[k] - step_rate * (mom[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-8)
    return Machine(at, float(p[0][0]), p[1], p[2])


def levelled(bins: list[np.ndarray], y: np.ndarray, counts: list[np.ndarray], false_alarms: float = 0.01, least_clean: int = 200, seed: int = 7) -> Machine:
    """The machine of all rows, its bias moved so that a score of 0.5 lets about that share of clean texts pass as toxic.

    The level is read off clean rows that a machine of the other half of the rows has not seen. It only ever makes the machine more
    sensitive, and never so that a text without a screened term is toxic. With fewer clean rows than ``least_clean`` the bias stays.
    """
    m = fit(bins, y, counts=counts)
    half = np.random.default_rng(seed).random(len(y)) < 0.5
    if (y == 0).sum() < least_clean or (y[half] == 1).sum() == 0 or (y[~half] == 1).sum() == 0:
        return m
    clean = []
    for fold in (half, ~half):
        other = fit([bins[k] for k in np.flatnonzero(~fold)], y[~fold], counts=[counts[k] for k in np.flatnonzero(~fold)])
        unseen = np.flatnonzero(fold & (y == 0))
        words = [np.repeat(bins[k], np.asarray(counts[k], np.int64)) for k in unseen]
        s = other.score(np.concatenate([np.zeros(0, np.int64), *words]), np.concatenate(([0], np.cumsum([len(w) for w in words]))))
        clean.append(np.log(s) - np.log1p(-s))
    level = np.quantile(np.concatenate(clean), 1 - false_alarms)
    m.bias += min(max(-level, 0.0), max(-0.5 - m.bias, 0.0))
    return m


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic", most_labels: int = 20_000, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sample = (
        labels.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out("doc_id"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labels)
    )
    sample = spark.createDataFrame(sample.collect(), "doc_id bigint, y int")

    def gather(source):
        for data, offs, more in K.batches(source, "text", "doc_id", "y"):
            b, at = terms(data, offs)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
            pair, n = np.unique(doc * BINS + b, return_counts=True)
            to = pa.array(np.searchsorted(pair, np.arange(len(offs)) * BINS), pa.int32())
            lists = [pa.ListArray.from_arrays(to, pa.array(v.astype(np.int32))) for v in (pair % BINS, n)]
            yield pa.RecordBatch.from_arrays([more["doc_id"], more["y"], *lists], ["doc_id", "y", "bins", "n"])

    got = narrow.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y").mapInArrow(gather, "doc_id bigint, y int, bins array<int>, n array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending")]).combine_chunks()
    lists, counts = ([np.asarray(b, np.int64) for b in got.column(c).to_numpy(zero_copy_only=False)] if got.num_rows else [] for c in ("bins", "n"))
    model = spark.sparkContext.broadcast(levelled(lists, got.column("y").to_numpy().astype(float), counts))

    def score(source):
        m = model.value
        for data, offs, more in K.batches(source, "text", "doc_id", "held_out"):
            s = m.score(*terms(data, offs))
            s = np.round(s, 9)
            yield pa.RecordBatch.from_arrays([more["doc_id"], more["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return narrow.withColumn("held_out", held_out("doc_id")).mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
