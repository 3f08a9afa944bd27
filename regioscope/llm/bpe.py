"""Byte-pair encoding with word ends, and decoding, by a pair occurrence index.

A text is read in units between ASCII white space and after ASCII letters that a mark follows; no word of the
vocabulary's pattern crosses such a place.
Every distinct unit that a worker meets is normalised and split into words once; the words of all units that
are new in a piece of the partition are encoded together. Their bytes stand in one linked array of
symbols. The index maps the rank of each mergeable pair to all places where the pair stands; ranks
that have places are taken in ascending order from a heap, every place still valid is merged, and the pairs
that a merge makes with its neighbours are put on the lists of their own ranks. A stale place is found when
its list is applied, as one of its two symbols has changed. Where a merge makes pairs of a lower rank (a
vocabulary may be built so; ``early``), only the first place in each word is merged before the lower ranks go.

The file is a ``tokenizers`` json of kind BPE with an end-of-word suffix, byte-level words, no decoder:
tokens are decoded as that library does without one, joined by single blanks, ids it does not know left out.
Added tokens in a text give their own ids, as by default.

Edge cases: null and empty texts give no ids and decode to an empty string; repeated rows are encoded each;
very long texts are encoded whole; bytes that are not UTF-8 read as U+FFFD; other columns, of any name, are carried in
``row``; empty tables give none.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import kernel as K
from .packing import readable

#: Words of ASCII text, lower-cased and without white space, under the pattern named ``SPLIT``.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_LETTER = K.table(bytes(range(65, 91)), bytes(range(97, 123)))
_MARK = K.table(bytes(range(0x21, 0x7F))) & ~_LETTER & ~K.table(bytes(range(0x30, 0x3A)))


class Vocabulary:
    """Token ids, merge ranks and their pair index for one file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, suffix = file["model"], file["model"]["end_of_word_suffix"]
        steps = [s["type"] for s in file["normalizer"]["normalizers"]]
        split = file["pre_tokenizer"]["pretokenizers"]
        if not suffix or file["decoder"] or steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in split] != ["Split", "ByteLevel"] or split[0]["pattern"] != {"Regex": SPLIT}:
            raise ValueError("not a BPE file with word ends, lower case and no decoder")
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are split off as plain strings")
        tok = Tokenizer.from_file(path)
        self.normal, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        vocab = model["vocab"]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.mark = _MARK & ~K.table("".join(self.added).encode())  # no added token is cut
        self.literal = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        rank = {(a, b): r for r, (a, b, _) in reversed([*enumerate(self.merges)])}
        self.with_next: dict[int, dict[int, int]] = {}  # first symbol of a pair: second: rank
        self.with_previous: dict[int, dict[int, int]] = {}
        for (a, b), r in rank.items():
            self.with_next.setdefault(a, {})[b] = r
            self.with_previous.setdefault(b, {})[a] = r
        least: dict[int, int] = {}
        for r, (a, b, _) in enumerate(self.merges):
            least.setdefault(a, r)
            least.setdefault(b, r)
        self.early = {r for r, (_, _, c) in enumerate(self.merges) if least.get(c, r) < r}
        pairs = sorted((a << 32 | b, r) for (a, b), r in rank.items())
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        tokens = {i: t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        most = max(tokens) + 1
        self.token_size = np.array([len(tokens[i]) if i in tokens else -1 for i in range(most)], np.int64)
        size = np.maximum(self.token_size, 0) + 1
        self.token_at = np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") + b" " for i in range(most)), np.uint8)

    def words_of(self, unit: bytes) -> list[bytes]:
        """The normalised words of one unit without added tokens."""
        if unit.isalpha():
            return [unit.lower()]
        if unit.isascii():
            return _ASCII.findall(unit.lower())
        text = self.normal(unit.decode())
        return [text[a:b].encode() for _, (a, b) in self.split(text)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the words' offsets, by the pair occurrence index."""
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = self.inner[data]
        start[end - 1] = self.last[data[end - 1]]
        n = len(start)
        is_last = np.zeros(n, bool)
        is_last[end - 1] = True
        place = np.flatnonzero(~is_last)
        keys = start[place] << 32 | start[np.minimum(place + 1, n - 1)]
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        place, ranks = place[found], self.pair_ranks[at[found]]
        order = np.argsort(ranks, kind="stable")
        place, ranks = place[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        index = {int(ranks[g[0]]): place[g].tolist() for g in np.split(np.arange(len(ranks)), cuts)} if len(ranks) else {}
        sym = start.tolist()
        after = np.where(is_last, -1, np.arange(1, n + 1)).tolist()
        before = np.concatenate(([-1], np.where(is_last[:-1], -1, np.arange(n - 1)))).tolist()
        word = np.repeat(np.arange(len(words)), size).tolist() if self.early else None
        heap = sorted(index)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            a, b, c = self.merges[r]
            follows, leads = self.with_next.get(c), self.with_previous.get(c)
            if a == b or r in self.early:
                places.sort()
            done: set[int] = set()
            kept = []
            for p in places:
                q = after[p]
                if q < 0 or sym[p] != a or sym[q] != b:
                    continue
                if word and r in self.early:
                    if word[p] in done:
                        kept.append(p)
                        continue
                    done.add(word[p])
                sym[p], sym[q] = c, -1
                q = after[q]
                after[p] = q
                if q >= 0:
                    before[q] = p
                    if follows and (x := follows.get(sym[q])) is not None:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            heapq.heappush(heap, x)
                if leads and (q := before[p]) >= 0 and (x := leads.get(sym[q])) is not None:
                    if x in index:
                        index[x].append(q)
                    else:
                        index[x] = [q]
                        heapq.heappush(heap, x)
            if kept:
                if r in index:
                    index[r] += kept
                else:
                    index[r] = kept
                    heapq.heappush(heap, r)
        ids = np.array(sym, np.int64)
        left = ids >= 0
        return ids[left], np.concatenate(([0], np.cumsum(left)[end - 1]))

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of lists of ids."""
        known = (ids >= 0) & (ids < len(self.token_size))
        known[known] = self.token_size[ids[known]] >= 0
        offs = np.concatenate(([0], np.cumsum(known)))[offs]
        ids = ids[known]
        size = self.token_size[ids] + 1
        to = np.concatenate(([0], np.cumsum(size)))
        out = self.token_bytes[np.repeat(self.token_at[ids] - to[:-1], size) + np.arange(to[-1])]
        some = np.diff(offs) > 0
        keep = np.ones(len(out), bool)
        keep[to[offs[1:][some]] - 1] = False  # no blank after the last token
        return out[keep], to[offs] - np.concatenate(([0], np.cumsum(some)))


class Units:
    """Ids by unit, kept by a worker. Beyond ``MOST`` units the table starts anew, so its memory does not grow with the texts."""

    MOST = 400_000

    def __init__(self, vocabulary: Vocabulary):
        self.of = vocabulary
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, units: list[bytes]) -> None:
        words: list[bytes] = []
        parts: list[list[int]] = []  # a number of a word, or ~id of an added token
        seen: dict[bytes, int] = {}
        for unit in units:
            part: list[int] = []
            pieces = self.of.literal.split(unit.decode()) if self.of.literal and b"<" in unit else None
            for piece in pieces or [None]:
                if piece in self.of.added:
                    part.append(~self.of.added[piece])
                    continue
                for w in self.of.words_of(unit if piece is None else piece.encode()):
                    if w not in seen:
                        seen[w] = len(words)
                        words.append(w)
                    part.append(seen[w])
            parts.append(part)
        ids, at = self.of.encode_words(words)
        flat = np.array([x for p in parts for x in p], np.int64)
        n = np.where(flat < 0, 1, np.diff(at)[np.maximum(flat, 0)] if len(words) else 1)
        to = np.concatenate(([0], np.cumsum(n)))
        from_ = np.where(flat < 0, 0, at[np.maximum(flat, 0)])
        got = (ids if len(ids) else np.zeros(1, np.int64))[np.minimum(np.repeat(from_ - to[:-1], n) + np.arange(to[-1]), max(len(ids) - 1, 0))]
        got[to[:-1][flat < 0]] = ~flat[flat < 0]
        ends = to[np.cumsum([len(p) for p in parts])]
        k = len(self.slot)
        self.slot |= {u: k + i for i, u in enumerate(units)}
        self.offs = np.concatenate((self.offs, len(self.ids) + ends))
        self.ids = np.concatenate((self.ids, got.astype(np.int32)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the texts' offsets."""
        s, e, at = K.words(data, offs, K.BLANK)
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        cuts = np.flatnonzero(_LETTER[data[:-1]] & self.of.mark[data[1:]]) + 1
        cuts = cuts[~np.isin(cuts, offs)]
        s = np.sort(np.concatenate((s, cuts)))
        e = np.sort(np.concatenate((e, cuts)))
        at = np.searchsorted(s, offs)
        solid = data[~K.BLANK[data]]
        ends = np.concatenate(([0], np.cumsum(e - s)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(solid)]).dictionary_encode()
        units = coded.dictionary.to_pylist()
        if len(self.slot) > self.MOST:
            self.clear()
        if new := [u for u in units if u not in self.slot]:
            self._learn(new)
        slot = np.array([self.slot[u] for u in units], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.offs[slot + 1] - self.offs[slot]
        to = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.repeat(self.offs[slot] - to[:-1], n) + np.arange(to[-1])], to[at]


_loaded: dict[str, Units] = {}


def loaded(path: str) -> Units:
    if path not in _loaded:
        _loaded[path] = Units(Vocabulary(path))
    return _loaded[path]


def _lists(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, piece: int = 1 << 20) -> DataFrame:
    """row (the kept columns; all without ``keep``) and ids for every row of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    df = docs.select(row, F.col(f"`{text}`").alias("text"))

    def run(source):
        units = loaded(path)
        for data, offs, more in K.batches(source, "text", "row", most=piece):
            ids, at = units.encode(*readable(data, offs))
            yield pa.RecordBatch.from_arrays([more["row"], _lists(ids, at)], ["row", "ids"])

    return df.mapInArrow(run, StructType([df.schema["row"], StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """The rows of encoded with ``decoded``, the text of their ids; null lists decode to an empty text, null ids are left out."""
    df = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "decoded"])

    def run(source):
        of = loaded(path).of
        for batch in source:
            lists = batch.column(ids).cast(pa.large_list(pa.int64()))
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(n)))
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b in K.pieces(at, 1 << 17):
                data, offs = of.decode(flat[at[a] : at[b]], at[a : b + 1] - at[a])
                text = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), text.cast(pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", StringType())]))
