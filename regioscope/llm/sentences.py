"""Removal of sentences covered by repeated runs of sentences.

Sentences end at . ! ? or a line break; pieces without a word belong to the sentence before. A run
starts at every sentence and is as many consecutive sentences as it takes to have ``run`` sentences and
``least_words`` words; one also ends at every sentence, so a repeated passage is covered from its first to
its last sentence. No run is passed over for being short: it is lengthened, and a text that has fewer
words in all is one run as a whole. A sentence of ``alone_words`` is a run of its own too, and so is one
of ``least_words`` that is all its text has. Runs are hashed (128 bits over their lower-cased words), meet
by hash across the corpus, and every sentence covered by a run that is not the first of its kind is
removed. First: smallest id, then earliest place.

Counts and minima are aggregated partially before the shuffle, and only hashes met in two documents
are joined back (a skewed join is split by the engine), so a run that a third of all rows share stays
spread. Repeats inside one document are found in the task that reads it.

Edge cases: null, empty and shorter texts lose nothing; null ids count as the smallest id; rows with
one id are one document in the order of ids (repeats between them stay); empty tables give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut

LEAST = -(1 << 63)
ENDS = K.table(b".!?\n")


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word counts, byte starts, document offsets); a sentence reaches to the next one's start."""
    low = K.LOWER[data]
    s, e, at = K.words(low, offs, K.ITEM_GAP)
    h = K.hash_spans(low, s, e)
    if not len(s):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ended = np.concatenate(([0], np.cumsum(ENDS[data])))
    first = np.concatenate(([True], ended[s[1:]] != ended[s[:-1]]))
    begin = np.zeros(len(s) + 1, bool)
    begin[at] = True
    first |= begin[:-1]
    f = np.flatnonzero(first)
    count = np.diff(np.append(f, len(s)))
    place = (np.arange(len(s)) - np.repeat(f, count)).astype(np.uint64)
    sh = K.mix(np.add.reduceat(K.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), f) + count.astype(np.uint64))
    return sh, count, s[f], np.searchsorted(f, at)


def spans(sh: np.ndarray, count: np.ndarray, to: np.ndarray, run: int, least_words: int, alone_words: int) -> tuple[np.ndarray, ...]:
    """Runs of sentences inside documents: two hashes, document, first sentence in it and the one after the last."""
    n = len(sh)
    total = np.concatenate(([0], np.cumsum(count)))
    i = np.arange(n)
    of = np.repeat(np.arange(len(to) - 1), np.diff(to))
    # every sentence has a word, so totals rise strictly
    end = np.maximum(i + run, np.searchsorted(total, total[:-1] + least_words))
    ok = end <= to[of + 1]
    begin = np.minimum(i + 1 - run, np.searchsorted(total, total[1:] - least_words, "right") - 1)
    back = begin >= to[of]
    lone = (count >= alone_words) | ((np.diff(to)[of] == 1) & (count >= least_words))
    few = np.flatnonzero((np.diff(to) >= run) & (total[to[1:]] - total[to[:-1]] < least_words))
    span = np.unique(np.concatenate((i[ok] * (n + 1) + end[ok], begin[back] * (n + 1) + i[back] + 1, i[lone] * (n + 1) + i[lone] + 1, to[few] * (n + 1) + to[few + 1])))
    s, e = span // (n + 1), span % (n + 1)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xA5A5A5A5A5A5A5A5):
        power, inverse = K.powers(n + 1)
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(sh ^ np.uint64(salt)) * power[:n], dtype=np.uint64)))
        out.append(K.mix((c[e] - c[s]) * inverse[s] + (e - s).astype(np.uint64)))
    doc = of[s]
    return *out, doc, s - to[doc], e - to[doc]


def in_document(a: np.ndarray, b: np.ndarray, doc: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """True where the run stands earlier in its own document."""
    order = np.lexsort((idx, b, a, doc))
    out = np.zeros(len(a), bool)
    if len(a):
        same = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (a, b, doc)])
        out[order[1:]] = same
    return out


def dedup_sentences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, run: int = 2, least_words: int = 16, alone_words: int = 50, cut_text: bool = False) -> DataFrame:
    """``keep`` columns as struct ``row``, with n_sentences, n_removed, removed (sentence numbers), kept_sha256 (and kept_text)."""
    keep = keep if keep is not None else docs.columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LEAST)).alias("doc"), F.xxhash64(body).alias("mark"), body.alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))

    def emit(source):
        for data, offs, more in K.batches(source, "text", "doc", "mark"):
            sh, count, _, to = sentences(data, offs)
            a, b, d, i, e = spans(sh, count, to, run, least_words, alone_words)
            new = ~in_document(a, b, d, i)
            a, b, d, i = a[new], b[new], d[new], i[new] << 31 | e[new]
            yield pa.RecordBatch.from_arrays([pa.array(K.i64(a)), pa.array(K.i64(b)), pa.array(more["doc"].to_numpy()[d]), pa.array(more["mark"].to_numpy()[d]), pa.array(i)], ["a", "b", "doc", "mark", "idx"])

    rows = base.select("doc", "mark", "text").mapInArrow(emit, "a bigint, b bigint, doc bigint, mark bigint, idx bigint")
    # written once: read for the counts and for the join, which then has two plain sides that the engine can split on skew
    rows = cut(rows)
    met = rows.groupBy("a", "b").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    met = cut(met)
    later = rows.join(met, ["a", "b"]).where("doc > first_doc")
    found = later.groupBy("doc", "mark").agg(F.collect_set("idx").alias("later"))

    def finish(source):
        for batch in source:
            raw, offs_all = K.text_arrays(batch.column("text"))
            later = batch.column("later").to_pylist()
            n, removed, sha, texts = [], [], [], []
            for x, y in K.pieces(offs_all):
                offs, data = offs_all[x : y + 1] - offs_all[x], raw[offs_all[x] : offs_all[y]]
                sh, count, start, to = sentences(data, offs)
                a, b, doc, idx, end = spans(sh, count, to, run, least_words, alone_words)
                dup = in_document(a, b, doc, idx)
                edge = np.zeros(len(sh) + 1, np.int64)
                np.add.at(edge, to[doc[dup]] + idx[dup], 1)
                np.add.at(edge, to[doc[dup]] + end[dup], -1)
                for d in range(y - x):
                    if later[x + d]:
                        v = np.array(later[x + d], np.int64)
                        np.add.at(edge, to[d] + (v >> 31), 1)
                        np.add.at(edge, to[d] + (v & 0x7FFFFFFF), -1)
                hit = np.cumsum(edge) > 0
                for d in range(y - x):
                    mine = np.flatnonzero(hit[to[d] : to[d + 1]])
                    n.append(int(to[d + 1] - to[d]))
                    removed.append(mine.tolist())
                    ends = np.append(start[to[d] : to[d + 1]], offs[d + 1])
                    kept, last = [], offs[d]
                    for i in mine.tolist():
                        kept.append(data[last : ends[i]].tobytes())
                        last = ends[i + 1]
                    kept.append(data[last : offs[d + 1]].tobytes())
                    left = b"".join(kept)
                    sha.append(hashlib.sha256(left).hexdigest())
                    if cut_text:
                        texts.append(left.decode("utf-8", "replace"))
            cols = {"row": batch.column("row"), "n_sentences": pa.array(n, pa.int64()), "removed": pa.array(removed, pa.list_(pa.int32())), "kept_sha256": pa.array(sha, pa.string())}
            if cut_text:
                cols["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    row = base.schema["row"].dataType.simpleString()
    schema = f"row {row}, n_sentences bigint, removed array<int>, kept_sha256 string" + ", kept_text string" * cut_text
    judged = base.join(found, ["doc", "mark"], "left").select("row", "text", "later")
    return judged.mapInArrow(finish, schema).withColumn("n_removed", F.size("removed").cast("bigint"))
