"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language, over lower-cased letters with everything else as one gap
character. Models are trained on at most ``most_docs`` whole labelled documents of each language (distinct
in id and text, chosen by hash; a parameter); tasks count their n-grams, and only counts reach the driver.
N-grams of all languages share sorted hash arrays: one array of keys for each order, with a column of
probabilities and interpolation weights for each language, so that a text's n-grams are looked up once
for all languages. The language of the lowest cross-entropy by character is chosen.

Rejection is calibrated on training documents left out of the counts: ``rejected`` is true where
the lowest cross-entropy exceeds the 0.995 quantile of those documents' entropies in their own
language. A text that is null or has no letter (marks
alone are none) is ``und`` with score 0; rejection changes no other
prediction, it is reported beside it.

Edge cases: no training rows: every text is ``und``; a null language is never learned; ties go to
the first language in order; repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut
from .toxicity import held_out

ORDER = 4
GAP = 32
#: Code points that hold letters and marks: all others are gaps.
_SPANS = (range(0x33000), range(0xE0100, 0xE01F0))
_fold: tuple[np.ndarray, np.ndarray] | None = None


def fold() -> tuple[np.ndarray, np.ndarray]:
    """By code point: lower-case letter or mark, or the gap; whether it is a letter (a mark alone is none)."""
    global _fold
    if _fold is None:
        out, letter = np.full(0x110000, GAP, np.uint32), np.zeros(0x110000, bool)
        for c in (c for span in _SPANS for c in span if not 0xD800 <= c < 0xE000):
            kind = unicodedata.category(ch := chr(c))[0]
            if kind in "LM":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
                letter[c] = kind == "L"
        _fold = out, letter
    return _fold


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded symbols with runs of gaps as one and a gap before each document; offsets; letters by document."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = np.minimum(lead[offs], len(cps))
    low, is_letter = fold()
    sym = low[cps]
    part = sym != GAP
    first = np.zeros(len(sym) + 1, bool)
    first[at] = True
    keep = part.copy()
    keep[1:] |= ~part[1:] & part[:-1] & ~first[1:-1]  # one gap after letters; none at a document's start
    kept = np.concatenate(([0], np.cumsum(keep)))[at]
    letters = np.diff(np.concatenate(([0], np.cumsum(is_letter[cps])))[at])
    return sym[keep], kept, letters


def padded(sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document after ORDER - 1 gaps; offsets of the padded documents."""
    n = np.diff(at)
    to = np.concatenate(([0], np.cumsum(n + ORDER - 1)))
    out = np.full(to[-1], GAP, np.uint32)
    out[np.arange(len(sym)) + np.repeat((np.arange(len(n)) + 1) * (ORDER - 1), n)] = sym
    return out, to


def grams(p: np.ndarray, k: int) -> np.ndarray:
    """Exact key of the k-gram that ends at each position from ORDER - 1 on: 21 bits a symbol; four are hashed."""
    key = np.zeros(len(p) - ORDER + 1, np.uint64)
    for j in range(k - 1, -1, -1):
        x = p[ORDER - 1 - j : len(p) - j].astype(np.uint64)
        key = key * np.uint64(0x100000001B3) + x if k > 3 else (key << np.uint64(21)) | x
    return K.mix(key + np.uint64(k))


class Models:
    """Sorted hash arrays by order, and by language what each holds."""

    def __init__(self, langs: list[str]):
        self.langs, self.keys, self.prob, self.weight, self.level = langs, [], [], [], 0.0

    def find(self, k: int, key: np.ndarray) -> np.ndarray:
        """Index in order k's array, or -1."""
        keys, start = self.keys[k], self.start[k]
        if not len(keys):
            return np.full(len(key), -1)
        top = (key >> np.uint64(46)).astype(np.int64)
        i, end = start[top], start[top + 1]
        out = np.full(len(key), -1)
        todo = np.flatnonzero(i < end)
        i, end = i[todo], end[todo]
        while len(todo):
            same = keys[i] == key[todo]
            out[todo[same]] = i[same]
            i = i + 1
            on = ~same & (i < end)
            todo, i, end = todo[on], i[on], end[on]
        return out

    def index(self) -> None:
        self.start = [np.searchsorted(k >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64)) for k in self.keys]

    def cost(self, p: np.ndarray) -> np.ndarray:
        """-log2 probability of the symbol at each position from ORDER - 1 on, a column for each language."""
        n, m = len(p) - ORDER + 1, len(self.langs)
        at = self.find(ORDER, grams(p, ORDER))
        out = np.empty((n, m), np.float32)
        hit = at >= 0
        out[hit] = self.full[at[hit]]
        todo = np.flatnonzero(~hit)
        if len(todo):
            q = np.lib.stride_tricks.sliding_window_view(p, ORDER)[todo]
            out[todo] = -np.log2(self.prob_of(q, ORDER))
        return out

    def prob_of(self, q: np.ndarray, k: int) -> np.ndarray:
        """Interpolated probabilities for rows of symbols, from order k down."""
        if k == 0:
            return np.full((len(q), len(self.langs)), self.floor)
        flat = np.ascontiguousarray(q).reshape(-1)
        own = grams(flat, k)[::ORDER]
        at = self.find(k, own)
        got = np.zeros((len(q), len(self.langs)))
        got[at >= 0] = self.prob[k][at[at >= 0]]
        left = np.ones((len(q), len(self.langs)))
        if k == 1:
            left *= self.weight[1]
        else:
            before = np.concatenate((np.full((len(q), 1), GAP, np.uint32), q[:, :-1]), 1)
            c = self.find_context(k, before)
            left[c >= 0] = self.weight[k][c[c >= 0]]
        return got + left * self.prob_of(q, k - 1)

    def find_context(self, k: int, before: np.ndarray) -> np.ndarray:
        key = grams(np.ascontiguousarray(before).reshape(-1), k - 1)[::ORDER]
        i = np.searchsorted(self.contexts[k], key)
        i[i == len(self.contexts[k])] = 0
        return np.where(self.contexts[k][i] == key, i, -1) if len(self.contexts[k]) else np.full(len(key), -1)


def counted(data: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram of the highest order, count) over documents with a group number each."""
    sym, at, _ = symbols(data, offs)
    p, to = padded(sym, at)
    pos = np.arange(max(0, len(p) - ORDER + 1)) + ORDER - 1
    doc = np.searchsorted(to, pos, "right") - 1
    inside = pos - to[doc] >= ORDER - 1
    rows = np.lib.stride_tricks.sliding_window_view(p, ORDER)[inside] if inside.any() else np.zeros((0, ORDER), np.uint32)
    got, n = np.unique(np.column_stack((group[doc[inside]].astype(np.uint32), rows)), axis=0, return_counts=True)
    return got[:, 0].astype(np.int64), got[:, 1:], n


def train(texts: dict[str, list[str]]) -> Models:
    """Models of texts at hand."""
    found = {}
    for g, t in texts.items():
        data, offs = K.text_arrays(pa.array(t, pa.large_string()))
        found[g] = counted(data, offs, np.zeros(len(t), np.int64))[1:]
    return fit(found)


def fit(found: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney with one absolute discount for each order and language, from counted n-grams."""
    langs = sorted(found)
    m = Models(langs)
    alphabet = np.unique(np.concatenate([r.reshape(-1) for r, _ in found.values()])) if found else np.zeros(0)
    m.floor = 1.0 / (len(alphabet) + 1000)
    per = {k: {} for k in range(1, ORDER + 1)}
    for gi, g in enumerate(langs):
        rows, n = found[g]
        for k in range(ORDER, 0, -1):
            # rows: distinct k-grams; n: counts at the highest order, numbers of left neighbours below it
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, inv = np.unique(rows[:, :-1], axis=0, return_inverse=True) if k > 1 else (np.zeros((1, 0), np.uint32), np.zeros(len(rows), int))
            inv = inv.reshape(-1)
            total, kinds = np.bincount(inv, n, len(ctx)), np.bincount(inv, minlength=len(ctx))
            per[k][gi] = (rows, (n - d) / total[inv] if len(rows) else np.zeros(0), ctx, np.divide(d * kinds, total, out=np.ones(len(ctx)), where=total > 0))
            if k > 1:
                rows, n = np.unique(rows[:, 1:], axis=0, return_counts=True)

    def keyed(rows: np.ndarray, k: int) -> np.ndarray:
        wide = np.concatenate((np.full((len(rows), ORDER - k), GAP, np.uint32), rows), 1)
        return grams(np.ascontiguousarray(wide).reshape(-1), k)[::ORDER] if len(rows) else np.zeros(0, np.uint64)

    m.keys, m.prob, m.weight, m.contexts = [np.zeros(0, np.uint64)], [None], [None], [None, None]
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([keyed(per[k][gi][0], k) for gi in range(len(langs))] or [np.zeros(0, np.uint64)]))
        prob = np.zeros((len(keys), len(langs)))
        ctx = np.unique(np.concatenate([keyed(per[k][gi][2], k - 1) for gi in range(len(langs))] or [np.zeros(0, np.uint64)])) if k > 1 else None
        weight = np.ones((len(ctx), len(langs))) if k > 1 else np.ones(len(langs))
        for gi in range(len(langs)):
            rows, pr, cx, wt = per[k][gi]
            prob[np.searchsorted(keys, keyed(rows, k)), gi] = pr
            if k > 1:
                weight[np.searchsorted(ctx, keyed(cx, k - 1)), gi] = wt
            elif len(wt):
                weight[gi] = wt[0]
        m.keys.append(keys)
        m.prob.append(prob)
        m.weight.append(weight)
        if k > 1:
            m.contexts.append(ctx)
    m.index()
    # the full interpolated cost of every known n-gram of the highest order, for all languages
    rows = np.unique(np.concatenate([per[ORDER][gi][0] for gi in range(len(langs))]), axis=0) if langs else np.zeros((0, ORDER), np.uint32)
    m.full = np.zeros((len(m.keys[ORDER]), len(langs)), np.float32)
    for a in range(0, len(rows), 1 << 16):
        part = rows[a : a + (1 << 16)]
        m.full[np.searchsorted(m.keys[ORDER], keyed(part, ORDER))] = -np.log2(m.prob_of(part, ORDER))
    return m


def judge(m: Models, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean cost by document and language, letters by document, symbols by document."""
    sym, at, letters = symbols(data, offs)
    p, to = padded(sym, at)
    n = np.diff(at)
    out = np.zeros((len(n), len(m.langs)))
    if len(sym):
        c = m.cost(p)
        start = to[:-1]
        for g in range(len(m.langs)):
            total = np.concatenate(([0.0], np.cumsum(c[:, g], dtype=np.float64)))
            # position i of c is symbol i + ORDER - 1 of p: a document's own symbols are start .. start + n
            out[:, g] = (total[np.minimum(start + n, len(c))] - total[np.minimum(start, len(c))]) / np.maximum(n, 1)
    return out, letters, n


def sample(narrow: DataFrame, most_docs: int, seed: int) -> DataFrame:
    """(lang, h, text) of at most ``most_docs`` distinct labelled rows of each language, by a hash of id and text."""
    from pyspark.sql import Window

    known = narrow.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), "text")
    # a threshold that leaves twice the documents asked for, then the least hashes: no language is sorted whole
    many = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n"))
    below = many.select("lang", F.least(F.lit(2.0**63), F.lit(2.0 * most_docs) / F.col("n") * F.lit(2.0**64) - F.lit(2.0**63)).alias("below"))
    few = known.select("lang", "h").join(F.broadcast(below), "lang").where(F.col("h").cast("double") <= F.col("below")).select("lang", "h").distinct()
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most_docs).select("lang", "h")
    return known.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most_docs: int = 600, seed: int = 9) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row of docs."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).withColumn("held_out", held_out("doc_id"))
    drawn = cut(sample(narrow, most_docs, seed))
    calibrates = drawn.count() >= 40
    apart = F.pmod(F.shiftright("h", 8), F.lit(8)) == 0 if calibrates else F.lit(False)

    def count(source):
        for data, offs, more in K.batches(source, "text", "lang"):
            code = more["lang"].dictionary_encode()
            g, rows, n = counted(data, offs, code.indices.to_numpy())
            wide = rows.astype(np.int64)
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(g)).cast(pa.string()), pa.array(wide[:, 0] << 21 | wide[:, 1]), pa.array(wide[:, 2] << 21 | wide[:, 3]), pa.array(n)], ["lang", "a", "b", "n"])

    # counts, not texts, reach the driver: distinct n-grams of the bounded sample
    got = drawn.where(~apart).select("lang", "text").mapInArrow(count, "lang string, a bigint, b bigint, n bigint").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    code = got.column("lang").combine_chunks().dictionary_encode()
    a, b, n, which = got.column("a").to_numpy(), got.column("b").to_numpy(), got.column("n").to_numpy(), code.indices.to_numpy()
    rows = np.column_stack((a >> 21, a & 0x1FFFFF, b >> 21, b & 0x1FFFFF)).astype(np.uint32)
    order = np.lexsort(rows.T[::-1])
    rows, n, which = rows[order], n[order], which[order]
    found = {g: (rows[which == k], n[which == k]) for k, g in enumerate(code.dictionary.to_pylist())}
    m = fit(found)
    trial = spark.sparkContext.broadcast(m)

    def own_cost(source):
        m = trial.value
        for data, offs, more in K.batches(source, "text", "lang", most=1 << 20):
            c, letters, _ = judge(m, data, offs)
            at = np.array([m.langs.index(g) if g in m.langs else -1 for g in more["lang"].to_pylist()], np.int64)
            ok = (letters > 0) & (at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[ok, at[ok]].astype(np.float64))], ["cost"])

    own = [r.cost for r in drawn.where(apart).select("lang", "text").mapInArrow(own_cost, "cost double").collect()] if calibrates else []
    m.level = float(np.quantile(own, 0.995)) if own else float("inf")
    model = spark.sparkContext.broadcast(m)

    def predict(source):
        m = model.value
        names = np.array([*m.langs, "und"], object)
        for data, offs, more in K.batches(source, "text", "doc_id", "held_out", most=1 << 20):
            c, letters, n = judge(m, data, offs)
            known = (letters > 0) & (len(m.langs) > 0)
            best = np.where(known, c.argmin(1) if len(m.langs) else 0, len(m.langs))
            low = c.min(1) if len(m.langs) else np.zeros(len(n))
            # posterior of the chosen language for a text of at most 20 such symbols, which keeps scores apart
            rel = np.exp2(-(c - low[:, None]) * np.minimum(n, 20)[:, None]).sum(1) if len(m.langs) else np.ones(len(n))
            score = np.where(known, np.round(1 / np.maximum(rel, 1), 9), 0.0)
            yield pa.RecordBatch.from_arrays([more["doc_id"], more["held_out"], pa.array(names[best], pa.string()), pa.array(score), pa.array(np.round(low, 6)), pa.array(known & (low > m.level))], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return narrow.select("doc_id", "text", "held_out").mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
