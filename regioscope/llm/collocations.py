"""Phrase collocations from depth-limited count tries, merged by prefix range.

Every task counts the words, pairs and triples of its texts in tries of depth ``depth``, one a language. In
memory a trie is one sorted array of packed paths (three word numbers in 63 bits) with counts; past ``NODES`` nodes it is
written out and a new one begins. Written out, a trie is depth first in byte order: for each node its depth, its last word's place in the word
list and its count, in chunks of 32,768 nodes that name the path they begin with.

The chunks' first paths are equidistant in the whole order, so a sample of them gives ranges of about ``a_range`` nodes; chunks are cut at the
ranges' bounds and each range merges its sorted pieces from all tasks. A path that every task has is one node in each, and a word
or a pair that begins very many phrases is spread over ranges, as bounds are full paths. Walking the merged trie gives each frequent
phrase its left parts, which are its ancestors; the few ancestors that stand before a range's first node come from the range that holds them. Right
parts are suffix links: a triple's leads to the pair of its last two words, a pair's to its last word, both frequent themselves, as no
part is rarer than its phrase.

Only numbers of nodes and the sample of paths reach the driver: at most 20 for each range and a million in all.

Edge cases: null and empty texts have no words; a null language is ``und``; words are bytes, also those that are not UTF-8; repeated rows count
each; very long texts are counted whole; equal scores go by count and then by the phrase's bytes; columns of other
names play no part; empty tables give none.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut

BREAK = K.table(b".,;:!?\n\v\f\r")
GAP = BREAK | K.table(b" \t")
BITS = 21
_LOW = (1 << BITS) - 1
#: Nodes (16 bytes each, and three times as much in passing) and words of a task's tries in memory, and nodes of a chunk of a written trie.
NODES, HELD, CHUNK = 2_000_000, 400_000, 32_768
#: Paths that reach the driver at most, of which the bounds of ranges are taken; they balance tasks and change no result.
SAMPLE = 1_000_000
#: Rows up to which a table of words and counts is broadcast; beyond, a merge join that the engine splits on skew.
WORDS = 200_000
CODEC = pa.Codec("zstd", 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts. Sorted runs in keys are merged."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])


def _in_order(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words in byte order, and each word's place there."""
    coded = pa.array(words, pa.binary())
    order = pc.array_sort_indices(coded)
    place = np.empty(len(words), np.int64)
    place[order.to_numpy()] = np.arange(len(words))
    return coded.take(order).to_pylist(), place


def pack_trie(keys: np.ndarray, counts: np.ndarray, words: list[bytes]) -> bytes:
    """A piece of a sorted trie as bytes. keys hold places in ``words`` (in byte order) plus one, three to a key."""
    a, b, c = keys >> 2 * BITS, keys >> BITS & _LOW, keys & _LOW
    depth = 1 + (b > 0) + (c > 0)
    last = np.where(c > 0, c, np.where(b > 0, b, a))
    head = np.array([a[0], b[0], c[0]])  # the path of the first node; those of the others follow from their depths
    used = np.unique(np.concatenate((last, head)))
    used = used[used > 0]
    table = b"\n".join(words[i - 1] for i in used.tolist())
    last = np.searchsorted(used, last).astype("<u4")
    head = np.where(head > 0, np.searchsorted(used, head) + 1, 0).astype("<i8")
    big = np.flatnonzero(counts > 254)
    small = np.where(counts > 254, 255, counts).astype(np.uint8)
    planes = last.view(np.uint8).reshape(-1, 4)[:, : 1 + (len(used) > 1 << 8) + (len(used) > 1 << 16)].T
    parts = [depth.astype(np.uint8).tobytes(), np.ascontiguousarray(planes).tobytes(), small.tobytes(), counts[big].astype("<i8").tobytes(), head.tobytes(), table]
    raw = np.array([len(keys), len(planes), len(big), len(table)], "<i8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def unpack_trie(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(keys, counts, words) of ``pack_trie``; keys hold places in the piece's own words plus one."""
    raw = np.frombuffer(CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    n, wide, big, text = raw[:32].view("<i8").tolist()
    at = np.cumsum([32, n, wide * n, n, 8 * big, 24, text])
    depth = raw[at[0] : at[1]]
    last = np.ones(n, np.int64)
    for i, plane in enumerate(raw[at[1] : at[2]].reshape(wide, n)):
        last += plane.astype(np.int64) << 8 * i
    counts = raw[at[2] : at[3]].astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[at[3] : at[4]].tobytes(), "<i8")
    head = np.frombuffer(raw[at[4] : at[5]].tobytes(), "<i8")
    path = []
    for d in (1, 2):  # the ancestor of that depth that stands last before or at each node
        node = np.where(depth == d, np.arange(n), -1)
        node = np.maximum.accumulate(node)
        path.append(np.where(node >= 0, last[node], head[d - 1]))
    a = path[0]
    b = np.where(depth >= 2, path[1], 0)
    c = np.where(depth == 3, last, 0)
    return a << 2 * BITS | b << BITS | c, counts, raw[at[5] : at[6]].tobytes().split(b"\n")


class Tries:
    """The count tries of one task, by language, over one list of words."""

    def __init__(self, depth: int):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.word: dict[bytes, int] = {}
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def _numbers(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        coded = _binary(data[~GAP[data]], np.concatenate(([0], np.cumsum(e - s)))).dictionary_encode()
        of = self.word
        numbers = np.array([of.setdefault(w, len(of)) for w in coded.dictionary.to_pylist()], np.int64)
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def full(self) -> bool:
        """Whether to write out before more is counted. Equal nodes are joined first."""
        if self.size <= NODES and len(self.word) <= HELD:
            return False
        for lang, parts in self.held.items():
            self.held[lang] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        self.size = sum(len(parts[0][0]) for parts in self.held.values())
        return self.size > NODES // 2 or len(self.word) > HELD

    def add(self, data: np.ndarray, offs: np.ndarray, langs: list[str], most: int = 200_000):
        """Counts the phrases of texts, those that begin at ``most`` words at once; yields after each such part."""
        lower = K.LOWER[data]
        s, e, at = K.words(lower, offs, GAP)
        if not len(s):
            return
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        piece = np.cumsum(BREAK[lower])[s]
        joined = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
        number = np.array([names[x] for x in langs])[doc]
        for lo in range(0, len(s), most):
            hi = min(lo + most, len(s))
            end = min(hi + self.depth - 1, len(s))  # words that phrases which begin before hi may reach
            seen = lower[s[lo] : e[end - 1]]
            w = self._numbers(seen, s[lo:end], e[lo:end]) + 1
            starts = np.arange(hi - lo)
            path = w[: hi - lo] << 2 * BITS
            keys, whose = [path], [number[lo:hi]]
            for d in range(1, self.depth):
                keep = (starts + lo + d < len(s)) & joined[np.minimum(starts + lo + d - 1, max(len(joined) - 1, 0))] if len(joined) else np.zeros(len(starts), bool)
                starts, path = starts[keep], path[keep]
                path = path | w[starts + d] << (2 - d) * BITS
                keys.append(path)
                whose.append(number[lo + starts])
            keys, whose = np.concatenate(keys), np.concatenate(whose)
            order = np.argsort(whose, kind="stable")
            keys, ends = keys[order], np.searchsorted(whose[order], np.arange(len(names) + 1))
            for x, a, b in zip(names, ends[:-1], ends[1:], strict=True):
                if b > a:
                    part = np.unique(keys[a:b], return_counts=True)
                    self.held.setdefault(x, []).append(part)
                    self.size += len(part[0])
            yield

    def chunks(self):
        """(lang, path of the first node, nodes, words counted, bytes) of all tries, each in order."""
        words, place = _in_order(list(self.word))
        place = np.concatenate(([0], place + 1))
        for lang in sorted(self.held):
            keys, counts = (np.concatenate(x) for x in zip(*self.held[lang], strict=True))
            keys = place[keys >> 2 * BITS] << 2 * BITS | place[keys >> BITS & _LOW] << BITS | place[keys & _LOW]
            keys, counts = _summed(keys, counts)
            for a in range(0, len(keys), CHUNK):
                k, n = keys[a : a + CHUNK], counts[a : a + CHUNK]
                yield lang, path_of(int(k[0]), words), len(k), int(n[(k & (1 << 2 * BITS) - 1) == 0].sum()), pack_trie(k, n, words)
        self.clear()


def path_of(key: int, words: list[bytes]) -> tuple[bytes, ...]:
    """The words of a key; missing ones are empty, so paths compare in the order of the trie."""
    return tuple(words[i - 1] if i else b"" for i in (key >> 2 * BITS, key >> BITS & _LOW, key & _LOW))


_PATH = "w1 binary, w2 binary, w3 binary"


def tries(docs: DataFrame, text: str, lang: str, depth: int) -> DataFrame:
    """lang, w1, w2, w3 (path of the first node), nodes, words, trie: the written tries of all tasks, in chunks."""

    def batch(rows):
        types = [pa.string(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.binary()]
        cols = list(zip(*[(x, *path, n, w, t) for x, path, n, w, t in rows], strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["lang", "w1", "w2", "w3", "nodes", "words", "trie"])

    def run(source):
        held = Tries(depth)
        for data, offs, more in K.batches(source, "text", "lang", most=1 << 20):
            for _ in held.add(data, offs, more["lang"].to_pylist()):
                if held.full():
                    yield from (batch([row]) for row in held.chunks())
        yield from (batch([row]) for row in held.chunks())

    df = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    return df.mapInArrow(run, f"lang string, {_PATH}, nodes bigint, words bigint, trie binary")


def _ranges(written: DataFrame, a_range: int) -> list[tuple]:
    """The paths at which ranges of about ``a_range`` nodes begin, without the first."""
    chunks, nodes = written.agg(F.count("*"), F.sum("nodes")).first()
    n = -(-(nodes or 0) // a_range)
    if n <= 1:
        return []
    share = min(1.0, min(20 * n, SAMPLE) / chunks)
    some = written.select("lang", "w1", "w2", "w3")
    some = some if share == 1 else some.sample(share, seed=13)
    firsts = sorted((r.lang.encode(), bytes(r.w1), bytes(r.w2), bytes(r.w3)) for r in some.collect())
    step = max(1.0, len(firsts) / n)
    return sorted({firsts[int(i * step)] for i in range(1, n) if int(i * step) < len(firsts)})


def _cut(written: DataFrame, bounds) -> DataFrame:
    """part, lang, trie: the chunks cut at the bounds of the ranges."""

    def run(source):
        for batch in source:
            for row in batch.to_pylist():
                lang, first = row["lang"].encode(), (row["w1"], row["w2"], row["w3"])
                part = bisect.bisect_right(bounds.value, (lang, *first))
                if part == len(bounds.value) or bounds.value[part][0] > lang:  # no bound of this language is left
                    yield _rows([(part, row["lang"], row["trie"])])
                    continue
                keys, counts, words = unpack_trie(row["trie"])
                a, out = 0, []
                while a < len(keys):
                    b = len(keys)
                    if part < len(bounds.value) and bounds.value[part][0] == lang:
                        b = bisect.bisect_left(keys, bounds.value[part][1:], lo=a, key=lambda k: path_of(int(k), words))
                    if b > a:
                        whole = a == 0 and b == len(keys)
                        out.append((part, row["lang"], row["trie"] if whole else pack_trie(keys[a:b], counts[a:b], words)))
                    a, part = b, part + 1
                yield _rows(out)

    def _rows(out):
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.binary()), strict=True)], ["part", "lang", "trie"])

    return written.select("lang", "w1", "w2", "w3", "trie").mapInArrow(run, "part int, lang string, trie binary")


def merge(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """One sorted trie of sorted pieces (places of the words of each node plus one, counts, words): word lists are merged, then runs of nodes."""
    got = [unpack_trie(p) for p in pieces]
    coded = pa.array([w for _, _, words in got for w in words], pa.binary()).dictionary_encode()
    words, place = _in_order(coded.dictionary.to_pylist())
    number, at, nodes = place[coded.indices.to_numpy(zero_copy_only=False)] + 1, 0, []
    for k, n, own in got:
        of = np.concatenate(([0], number[at : at + len(own)]))
        at += len(own)
        nodes.append((of[k >> 2 * BITS], of[k >> BITS & _LOW], of[k & _LOW], n))
    a, b, c, n = (np.concatenate(x) for x in zip(*nodes, strict=True))
    if len(words) < _LOW:
        order = np.argsort(a << 2 * BITS | b << BITS | c, kind="stable")
    else:
        order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))))
    return a[first], b[first], c[first], np.add.reduceat(n, first), words


def walk(a: np.ndarray, b: np.ndarray, c: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes with ``least`` or more, counts of their ancestors of depth 1 and 2; 0 where there is none in this trie)."""
    node = np.arange(len(a))
    one = np.maximum.accumulate(np.where(b == 0, node, -1))
    two = np.maximum.accumulate(np.where((b > 0) & (c == 0), node, -1))
    l1 = np.where((b > 0) & (one >= 0) & (a == a[one]), counts[one], 0)
    l2 = np.where((c > 0) & (two >= 0) & (a == a[two]) & (b == b[two]), counts[two], 0)
    often = np.flatnonzero(counts >= least)
    return often, l1[often], l2[often]


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", depth: int = 3, least: int = 10, a_range: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f, l1, l2 for every phrase met ``least`` times; lang, n).

    w2 and w3 are null in shorter phrases; l1 and l2 are the counts of the first word and the first two where the phrase is longer.
    """
    spark = docs.sparkSession
    written = cut(tries(docs, text, lang, depth))
    bounds = spark.sparkContext.broadcast(_ranges(written, a_range))

    def run(source):
        part, held = None, {}
        for batch in source:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield from merged(held)
                    part, held = row["part"], {}
                held.setdefault(row["lang"], []).append(row["trie"])
        yield from merged(held)

    def merged(held):
        for x in sorted(held):
            *path, counts, words = merge(held[x])
            often, l1, l2 = walk(*path, counts, least)
            table = pa.array(words, pa.binary())
            cols = [pa.array([x] * len(often), pa.string())]
            cols += [table.take(pa.array(w[often] - 1, pa.int64(), mask=w[often] == 0)) for w in path]
            cols += [pa.array(c, pa.int64(), mask=c == 0) for c in (counts[often], l1, l2)]
            for k in range(0, len(often), 10_000):
                yield pa.RecordBatch.from_arrays([c[k : k + 10_000] for c in cols], ["lang", "w1", "w2", "w3", "f", "l1", "l2"])

    parts = _cut(written, bounds).repartition(len(bounds.value) + 1, "part").sortWithinPartitions("part")
    found = cut(parts.mapInArrow(run, f"lang string, {_PATH}, f bigint, l1 bigint, l2 bigint"))
    n = cut(written.groupBy("lang").agg(F.sum("words").alias("n")))
    if n.count() <= WORDS:
        n = F.broadcast(n)
    # At most one word and one pair for each range stand before its first node.
    lone = F.col("w2").isNotNull() & F.col("l1").isNull()
    first = found.where(lone).select("lang", "w1").distinct().join(found.where("w2 is null").select("lang", "w1", F.col("f").alias("m1")), ["lang", "w1"])
    pair = found.where("w3 is not null and l2 is null").select("lang", "w1", "w2").distinct().join(found.where("w2 is not null and w3 is null").select("lang", "w1", "w2", F.col("f").alias("m2")), ["lang", "w1", "w2"])
    if len(bounds.value) <= WORDS:
        first, pair = F.broadcast(first), F.broadcast(pair)
    got = found.join(first, ["lang", "w1"], "left").join(pair, ["lang", "w1", "w2"], "left")
    l1, l2 = F.coalesce("l1", "m1"), F.coalesce("l2", "m2")
    return got.select("lang", "w1", "w2", "w3", "f", l1.alias("l1"), F.when(F.col("w3").isNotNull(), l2).alias("l2")), n


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * a / (left * right)) in whole numbers; products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    both = (wide(a) * wide(a)) * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", both, wide(left) * wide(right))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, scale: int = 1_000_000, share: int = 50, a_range: int = 500_000) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two or three words met ``least`` times that no longer one explains.

    A phrase is cut where it scores lowest. One that stands in a longer candidate in ``share`` per cent of its occurrences or more is dropped.
    """
    got, n = frequent(docs, text=text, lang=lang, least=least, a_range=a_range)
    got = cut(got)
    words = got.where("w2 is null").select("lang", F.col("w1").alias("w"), F.col("f").alias("r"))
    pairs = got.where("w2 is not null and w3 is null").select("lang", "w1", "w2", "f", "l1")
    triples = got.where("w3 is not null").select("lang", "w1", "w2", "w3", "f", "l1", "l2")
    if words.count() <= WORDS:
        words = F.broadcast(words)
    pairs = cut(pairs.join(words.withColumnRenamed("w", "w2"), ["lang", "w2"]))
    links = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1"), F.col("r").alias("r2"))
    triples = cut(triples.join(links, ["lang", "w2", "w3"]))
    inside = triples.select("lang", "w1", "w2", "f").union(triples.select("lang", "w2", "w3", "f")).groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
    kept = pairs.join(inside, ["lang", "w1", "w2"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("f") * share, F.lit(True)))
    space = F.lit(b" ")
    two = kept.select("lang", F.concat("w1", space, "w2").alias("phrase"), F.col("f").alias("a"), F.col("l1").alias("l"), "r", _score(F.col("f"), F.col("l1"), F.col("r"), scale).alias("score"))
    one, other = _score(F.col("f"), F.col("l1"), F.col("r1"), scale), _score(F.col("f"), F.col("l2"), F.col("r2"), scale)
    scored = triples.withColumns({"one": one, "other": other})
    late = F.col("other") < F.col("one")
    three = scored.select(
        "lang", F.concat("w1", space, "w2", space, "w3").alias("phrase"), F.col("f").alias("a"), F.when(late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(late, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("one", "other").alias("score"),
    )
    return two.union(three).join(n, "lang").withColumn("phrase", F.col("phrase").cast("string"))


def best(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their rank: first of shares of a language, then of what is left of them."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shares = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    few = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.withColumn("rank", F.col("rank").cast("bigint")).drop("share")
