"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

Normal form: A-Z lower-cased, words are runs of ASCII letters, digits and non-ASCII characters. A
benchmark item gives every window of ``width`` consecutive words; an item of fewer words, but not
none, is one window. Training texts are scanned window by window with rolling hashes, a hash that is
in the set is verified on the words themselves, and every word inside a verified window is hit.

The set is broadcast as sorted arrays (some 16 bytes a window), at most ``block_bytes`` of benchmark text
at once. One block holds any usual benchmark, and texts are scanned without a shuffle. A larger benchmark
is scanned block by block, each pass writing only what was hit, by text; blocks come to the driver one
after the other, and the hits are joined back, so memory is bounded whatever its size and results stay whole.

Edge cases: a null text has no words; null or repeated items are ignored or counted once; an empty
benchmark hits nothing; repeated rows are judged each; other columns pass through untouched.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut

_SEEN = 22


class Windows:
    """Distinct windows by length: sorted hashes, the first word of each in the benchmark's text, and its items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        data, offs = K.text_arrays(pa.array([t for _, t in items], pa.large_string()))
        self.names = [i for i, _ in items]
        self.data = K.LOWER[data]
        self.s, self.e, at = K.words(self.data, offs, K.ITEM_GAP)
        h, count = K.hash_spans(self.data, self.s, self.e), np.diff(at)
        self.by: dict[int, tuple[np.ndarray, ...]] = {}
        for length in np.unique(np.minimum(count[count > 0], width)).tolist():
            mine = np.flatnonzero(np.minimum(count, width) == length)
            n = count[mine] - length + 1
            item = np.repeat(mine, n)
            word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[item]
            key = K.rolling(h, length)[word]
            order = np.lexsort((item, key))
            key, word, item = key[order], word[order], item[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            for i in np.flatnonzero(~new).tolist():  # equal hashes are equal words, or windows of their own
                new[i] = self.text(word[i], length) != self.text(word[i - 1], length)
            first = np.flatnonzero(new)
            self.by[length] = key[first], word[first], np.append(first, len(key)), item
        self.keys = {n: x[0] for n, x in self.by.items()}

    def text(self, word: int, length: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.s[word : word + length], self.e[word : word + length], strict=True))

    def who(self, length: int, h: int, words: bytes) -> set[str]:
        """Items with a window of these words."""
        keys, word, to, item = self.by[length]
        k, out = int(np.searchsorted(keys, h)), set()
        while k < len(keys) and keys[k] == h:
            if self.text(word[k], length) == words:
                out.update(self.names[i] for i in item[to[k] : to[k + 1]].tolist())
            k += 1
        return out

    def seen(self) -> dict[int, np.ndarray]:
        """By length, a table of the hashes' low bits, which most windows fail."""
        out = {}
        for n, keys in self.keys.items():
            out[n] = np.zeros(1 << _SEEN, bool)
            out[n][keys & np.uint64((1 << _SEEN) - 1)] = True
        return out


def _blocks(benchmark: DataFrame, item: str, text: str, width: int, block_bytes: int):
    """(number of blocks, the blocks one by one); each is at most about block_bytes of text, or one item."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    size = rows.select(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    parts = (rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows for b in range(n))
    return n, (Windows([(r.i, r.t) for r in part.collect()], width) for part in parts)


def _scanner(shared, cut_text: bool):
    names = ["n_words", "hit_spans", "items"]

    def scan(source):
        found: Windows = shared.value
        seen = found.seen()
        mask = np.uint64((1 << _SEEN) - 1)
        for batch in source:
            raw, offs_all = K.text_arrays(batch.column("text"))
            before_s = batch.column("hit_spans").to_pylist()
            before_i = batch.column("items").to_pylist()
            out_n, out_s, out_i, out_t = [], [], [], []
            for a, b in K.pieces(offs_all):
                offs = offs_all[a : b + 1] - offs_all[a]
                orig = raw[offs_all[a] : offs_all[b]]
                data = K.LOWER[orig]
                s, e, at = K.words(data, offs, K.ITEM_GAP)
                h = K.hash_spans(data, s, e)
                items: dict[int, set] = defaultdict(set)
                delta = np.zeros(len(s) + 1, np.int64)
                for length, keys in found.keys.items():
                    r, to = K.runs(h, at, length, False)
                    idx = np.flatnonzero(seen[length][r & mask])
                    k = np.searchsorted(keys, r[idx])
                    idx = idx[(k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == r[idx])]
                    doc = np.searchsorted(to, idx, "right") - 1
                    for i, d, w in zip(r[idx], doc.tolist(), (at[doc] + idx - to[doc]).tolist(), strict=True):
                        mine = b" ".join(data[s[x] : e[x]].tobytes() for x in range(w, w + length))
                        if who := found.who(length, i, mine):
                            items[d].update(who)
                            delta[w] += 1
                            delta[w + length] -= 1
                for d in range(b - a):
                    for x, y in zip(*[iter(before_s[a + d] or [])] * 2, strict=True):
                        delta[at[d] + x] += 1
                        delta[at[d] + y] -= 1
                hit = np.cumsum(delta[:-1]) > 0
                for d in range(b - a):
                    lo, hi = at[d], at[d + 1]
                    out_n.append(int(hi - lo))
                    out_i.append(sorted(items[d] | set(before_i[a + d] or [])) if d in items or before_i[a + d] else [])
                    mine = hit[lo:hi]
                    if not mine.any():
                        out_s.append([])
                        if cut_text:
                            out_t.append(None)
                        continue
                    flips = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                    out_s.append(flips.tolist())
                    if cut_text:
                        keep, last = [], offs[d]
                        for x, y in flips.reshape(-1, 2):
                            keep.append(orig[last : s[lo + x]].tobytes())
                            last = e[lo + y - 1]
                        keep.append(orig[last : offs[d + 1]].tobytes())
                        out_t.append(b"".join(keep).decode("utf-8", "replace"))
            cols = {"row": batch.column("row"), "text": batch.column("text"), "n_words": pa.array(out_n, pa.int64()), "hit_spans": pa.array(out_s, pa.list_(pa.int64())), "items": pa.array(out_i, pa.list_(pa.string()))}
            if cut_text:
                cols["clean_text"] = pa.array(out_t, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    scan.names = names
    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 32 << 20, cut_text: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` as struct ``row``, with n_words, n_hit, hit_spans (word ranges), items.

    ``cut_text`` adds clean_text: the text without the hit spans, null where nothing is hit.
    """
    keep = keep if keep is not None else docs.columns
    none = {"hit_spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")}
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    row, sc = df.schema["row"].dataType.simpleString(), docs.sparkSession.sparkContext
    out = "n_words bigint, hit_spans array<bigint>, items array<string>"
    n, blocks = _blocks(benchmark, item, item_text, width, block_bytes)
    if n == 1:
        df, last = df.withColumns(none), next(blocks)
    else:
        exact, hits = F.sha2("text", 256), None
        texts = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null").withColumns(none).select(F.struct(exact.alias("sha")).alias("row"), "text", "hit_spans", "items")
        for block in blocks:
            shared = sc.broadcast(block)
            got = texts.mapInArrow(_scanner(shared, False), f"row struct<sha: string>, text string, {out}").where(F.size("hit_spans") > 0)
            got = cut(got.select("row.sha", "hit_spans", "items").distinct())
            shared.destroy()
            hits = got if hits is None else hits.union(got)
        hits = cut(hits.groupBy("sha").agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("items")).alias("items")))
        df = df.withColumn("sha", exact).join(hits, "sha", "left").select("row", "text", *[F.coalesce(c, v).alias(c) for c, v in none.items()])
        last = Windows([], width)
    df = df.select("row", "text", "hit_spans", "items").mapInArrow(_scanner(sc.broadcast(last), cut_text), f"row {row}, text string, {out}" + ", clean_text string" * cut_text)
    pairs = F.transform(F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2)), lambda i: F.element_at("hit_spans", i + 2) - F.element_at("hit_spans", i + 1))
    n_hit = F.when(F.size("hit_spans") > 0, F.aggregate(pairs, F.lit(0).cast("bigint"), lambda x, y: x + y)).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn("n_hit", n_hit).drop("text")
