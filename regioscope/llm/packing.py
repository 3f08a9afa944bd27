"""Packing of token sequences by minimum bin slack.

Texts are tokenised whole; an end id follows each. A document's ids are cut every ``window`` ids:
full pieces are sequences of their own, the remainders are packed. The remainders' lengths form a
multiset with fewer than ``window`` distinct values, however many documents there are. On that
histogram the driver plans: the longest length left is placed, a bitset subset-sum programme over
the other lengths (counts split in powers of two) finds the sum closest to the window's capacity,
backtracking gives the counts used, and the pattern is repeated as often as the counts last, so every
pattern uses up a length's supply and the plan stays short. Documents find their places by
their rank among equal lengths, counted by buckets, so a length that a third of all rows have is
ranked in parts. Ids never pass through a shuffle.

Tokenising: the byte-level vocabulary splits a text before it merges, and no piece crosses a single
blank, a single line break or the end of a run of ASCII letters. Units between such places are
encoded once for each task and looked up by hash after that, with ids equal to encoding the text whole.
With ``added``, the file's added tokens (``<|endoftext|>``) are split off first and give their own ids,
as ``tokenizers`` does by default; without, they are ordinary text.

Edge cases: null and empty texts have just the end id; repeated rows are packed each; very long
texts give many full pieces; bytes that are not UTF-8 read as U+FFFD; an empty table gives none.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 1
_LETTER = K.table(bytes(range(65, 91)), bytes(range(97, 123)))
_SOLID = K.table(bytes(range(0x21, 0x7F)))
_LEAD = K.table(bytes(range(0xC3, 0xE0)))  # two-byte characters from U+00C0 on: none is white space
_PUNCT = _SOLID & ~_LETTER & ~K.table(bytes(range(0x30, 0x3A)))


def starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places at which encoding can be cut without changing the ids."""
    n = len(data)
    solid = _SOLID[data]
    lead = _LEAD[data]
    before = np.zeros(n, bool)  # the character that ends just before i is known to be solid
    before[1:] = solid[:-1]
    before[2:] |= lead[:-2] & (data[1:-1] >= 0x80)
    after = np.zeros(n, bool)  # the character that starts just after i is
    after[:-1] = solid[1:] | lead[1:]
    edge = before & after
    cutat = np.zeros(n + 1, bool)
    cutat[:n] |= edge & (data == 0x20)
    line = edge & (data == 0x0A)
    cutat[:n] |= line
    cutat[1:] |= line
    cutat[1:n] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    cutat[offs] = True
    return np.flatnonzero(cutat[:n])


def readable(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with U+FFFD for bytes that are not UTF-8, as they are decoded for a tokenizer."""
    raw = data.tobytes()
    try:
        raw.decode()
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return data, offs


class Encoder:
    """Ids by unit hash, kept over a task; the vocabulary is read from a byte-level BPE json.

    Beyond ``MOST`` units the table starts anew, so a worker's memory does not grow with its texts.
    """

    MOST = 400_000

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are split off as plain strings")
        self.added = {t["content"].encode(): t["id"] for t in file["added_tokens"]} if added else {}
        self.literal = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of, extra = {chr(b): b for b in printable}, 256
        for b in range(256):
            if b not in printable:
                of[chr(extra)] = b
                extra += 1
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if all(c in of for c in t)}
        ranks.pop(b"<|endoftext|>", None)
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.at, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, hashes: list[int], ids: np.ndarray, n: np.ndarray) -> None:
        k = len(self.slot)
        for h in hashes:
            self.slot[h] = k
            k += 1
        while k > len(self.at):
            self.at, self.n = np.concatenate((self.at, self.at * 0)), np.concatenate((self.n, self.n * 0))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids * 0))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[k - len(hashes) : k] = self.used + np.cumsum(n) - n
        self.n[k - len(hashes) : k] = n
        self.used += len(ids)

    def _joined(self, hashes: list[int], units: list[bytes], join: bytes) -> None:
        if not units:
            return
        ids = np.array(self.bpe.encode_ordinary(join.join(units).decode("utf-8", "replace")), np.int32)
        ends = np.cumsum(self.size[ids])
        size = np.array([len(u) for u in units])
        stop = np.cumsum(size + len(join)) - len(join)
        b = np.searchsorted(ends, stop) + 1
        a = np.concatenate(([0], b[:-1] + (1 if join else 0)))
        if not (ends[b - 1] == stop).all():
            raise RuntimeError("a unit's ids cross its end")
        n = b - a
        flat = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self._add(hashes, ids[flat], n)

    def _split(self, data: np.ndarray, offs: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Unit starts with each added token a unit of its own; a token does not reach over a document's end."""
        raw = data.tobytes()
        found = []
        if any(t in raw for t in self.added):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                found += [m.span() for m in self.literal.finditer(raw, a, b)]
        if not found:
            return s
        a, b = np.array(found, np.int64).T
        inside = np.searchsorted(a, s, "left") > np.searchsorted(b, s, "right")  # a < s < b
        s = np.union1d(s[~inside], np.concatenate((a, b)))
        return s[s < len(data)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and document offsets; without end ids."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        s = starts(data, offs)
        if self.literal:
            s = self._split(data, offs, s)
        e = np.append(s[1:], len(data))
        u, first, back = np.unique(K.hash_spans(data, s, e), return_index=True, return_inverse=True)
        if len(self.slot) > self.MOST:
            self.clear()
        keys = u.tolist()
        new = [k for k, x in enumerate(keys) if x not in self.slot]
        if new:
            raw = data.tobytes()
            kinds: tuple[list, list, list] = ([], [], [])
            for k in new:
                t = raw[s[first[k]] : e[first[k]]]
                if t in self.added:
                    self._add([keys[k]], np.array([self.added[t]], np.int32), np.array([1]))
                    continue
                tail = 0x21 <= t[-1] < 0x7F or (len(t) > 1 and 0xC3 <= t[-2] < 0xE0)
                blank = t[0] == 0x20 and len(t) > 1 and (0x21 <= t[1] < 0x7F or 0xC3 <= t[1] < 0xE0)
                kinds[0 if blank and tail else 1 if tail and (0x21 <= t[0] < 0x7F or 0xC3 <= t[0] < 0xE0) else 2].append((keys[k], t))
            self._joined([h for h, _ in kinds[0]], [t for _, t in kinds[0]], b"")
            self._joined([h for h, _ in kinds[1]], [t for _, t in kinds[1]], b"\n")
            for h, t in kinds[2]:
                ids = np.array(self.bpe.encode_ordinary(t.decode("utf-8", "replace")), np.int32)
                self._add([h], ids, np.array([len(ids)]))
        slot = np.array([self.slot[x] for x in keys])[back]
        n = self.n[slot]
        total = np.concatenate(([0], np.cumsum(n)))
        flat = np.repeat(self.at[slot] - total[:-1], n) + np.arange(total[-1])
        return self.ids[flat], total[np.searchsorted(s, offs)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def plan(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: uses}) until every length is used up; sums are as close to the window as can be."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        room = window - longest
        use = {longest: 1}
        if room > 0:
            full, reach, trail = (1 << (room + 1)) - 1, 1, []
            for n in sorted(left, reverse=True):
                if n > room:
                    continue
                most, k = min(left[n] - (n == longest), room // n), 1
                while most > 0:
                    k2 = min(k, most)
                    trail.append((n, k2, reach))
                    reach |= reach << (n * k2) & full
                    most -= k2
                    k *= 2
                    if reach >> room & 1:
                        break
                if reach >> room & 1:
                    break
            total = reach.bit_length() - 1
            for n, k, before in reversed(trail):
                if not before >> total & 1:
                    use[n] = use.get(n, 0) + k
                    total -= n * k
        times = min(left[n] // k for n, k in use.items())
        out.append((times, use))
        for n, k in use.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def pieces_of(docs: DataFrame, vocabulary: str, key: str, text: str, window: int, with_ids: bool = False, added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) for every piece."""

    def emit(source):
        enc = encoder(vocabulary, added)
        enc.clear()  # a worker serves many tasks; what the last one held goes
        for data, offs, more in K.batches(source, "text", "doc_id"):
            data, offs = readable(data, offs)
            ids, at = enc.encode(data, offs)
            ids = np.insert(ids, at[1:], END_ID).astype("<u4")
            at = at + np.arange(len(at))
            size = np.diff(at)
            n = -(-size // window)
            doc = np.repeat(np.arange(len(size)), n)
            start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, size[doc] - start)
            lo = at[doc] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            cols = {"doc_id": more["doc_id"].take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(size[doc])}
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(lo, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
        enc.clear()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(emit, schema)


def pack(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", window: int = 2048, rows_a_bucket: int = 100_000, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; a sequence holds at most ``window`` ids, without gaps."""
    spark = docs.sparkSession
    got = cut(pieces_of(docs, vocabulary, key, text, window, with_ids, added))
    hist = {r.length: r.n for r in got.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = plan({n: c for n, c in hist.items() if n < window}, window)
    rows, seq, used = [], 0, {}
    for times, use in patterns:
        off = 0
        for n, k in sorted(use.items(), reverse=True):
            r = used.get(n, 0)
            rows.append((n, r, r + k * times, seq, k, off))
            used[n] = r + k * times
            off += n * k
        seq += times
    if window in hist:
        rows.append((window, 0, hist[window], seq, 1, 0))
    places = spark.createDataFrame(rows, "length bigint, lo bigint, hi bigint, seq bigint, uses bigint, off bigint")
    buckets = max(16, sum(hist.values()) // rows_a_bucket)
    b = got.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = (
        b.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    mine = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = b.withColumn("k", F.row_number().over(mine)).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    put = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])).drop(places["length"])
    step = F.col("rank") - F.col("lo")
    return put.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("seq") + F.floor(step / F.col("uses"))).cast("bigint").alias("sequence_id"),
        (F.col("off") + step % F.col("uses") * F.col("length")).cast("bigint").alias("offset"), *(["ids"] if with_ids else []),
    )
