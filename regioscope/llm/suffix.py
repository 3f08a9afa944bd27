"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte is removed when a ``length``-byte string that covers it also starts earlier (smaller id, or
the same document and an earlier start). Matches never cross documents, overlaps count, and all
strings are judged on the input.

1. Equal texts (by SHA-256 and length) are one text: the copy of the smallest id stands for them, the
   others are repeats from end to end.
2. Every window of ``length`` bytes has one anchor, its rightmost least k-gram hash. Equal windows
   have equal anchors at equal offsets, so only windows of anchors whose hash occurs twice can repeat.
   An anchor met twice within a task is known to repeat and is not gathered by its hash, so a
   passage that a third of all rows share sends one row a task there.
3. The bytes around repeating anchors (its windows: length + window - 1 bytes at most) meet by anchor
   hash. Equal contexts collapse. Where contexts differ, the suffixes at their windows are sorted by
   a mergesort whose comparison finds the common extension by binary search over prefix polynomial
   hashes, in a logarithmic number of steps; neighbours whose common extension reaches ``length``
   are equal strings, which is verified on the bytes. An anchor hash with more than HEAVY rows is dealt out
   further, by the bytes that all windows of a block of BLOCK offsets have in common; one with more than
   VERY_HEAVY window by window, where contexts are equal or never meet, so all of them collapse and a
   passage that any number of rows share leaves one row a task. Equal strings still meet.
4. Removed ranges are gathered by document, and merged.

Edge cases: null and short texts lose nothing; null ids count as the smallest id; rows equal in id
and text are one document (none of them is an earlier start of another); empty tables give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, release

LEAST = -(1 << 63)
#: Bytes of the anchoring k-gram.
GRAM = 24
#: An anchor hash with more contexts than the first is dealt out by common bytes too, with more than the second by whole windows.
HEAVY, VERY_HEAVY = 4096, 65_536
BLOCK = 8
#: Bytes of contexts that a task settles at once.
PORTION = 1 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    got, span = x, 1
    while span * 2 <= w:
        got = np.minimum(got[:-span], got[span:])
        span *= 2
    return np.minimum(got[: len(x) - w + 1], got[w - span : w - span + len(x) - w + 1]) if span < w else got


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one text of at least ``length`` bytes: anchor hashes, positions, first and last window start of each."""
    n = len(data)
    w = length - GRAM + 1
    h = np.empty(n - GRAM + 1, np.uint64)
    for a in range(0, len(h), K.CHUNK):
        b = min(len(h), a + K.CHUNK)
        c = K.prefix_hash(data[a : b + GRAM - 1])
        h[a:b] = K.mix((c[GRAM : b - a + GRAM] - c[: b - a]) * K.powers(b - a)[1])
    low = sliding_min(h, w)
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    end = np.append(start[1:], len(low))
    # a place of some window's minimum is one whose hash is the largest of the minima of its windows
    pad = np.zeros(w - 1, np.uint64)
    cand = np.flatnonzero(h == ~sliding_min(~np.concatenate((pad, low, pad)), w))
    if len(cand) == len(start) and (h[cand] == low[start]).all():
        return h[cand], cand, start, end - 1
    out = []  # ties: a run of windows with equal minima has several places
    lo, hi = np.searchsorted(cand, start), np.searchsorted(cand, end + w - 1)
    for r in range(len(start)):
        c = cand[lo[r] : hi[r]]
        c = c[h[c] == low[start[r]]]
        to = np.minimum(np.append(c[1:] - w, end[r] - 1), end[r] - 1)  # windows before the next place comes in
        fr = np.maximum(np.append(start[r], to[:-1] + 1), start[r])
        ok = fr <= to
        out.append((h[c[ok]], c[ok], fr[ok], to[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def lcp(c: np.ndarray, inv: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common extension (up to ``most``) of the suffixes at a and b, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while True:
        on = lo < hi
        if not on.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = (c[a + mid] - c[a]) * inv[a] == (c[b + mid] - c[b]) * inv[b]
        lo = np.where(on & same, mid, lo)
        hi = np.where(on & ~same, mid - 1, hi)


def suffix_sort(data: np.ndarray, c: np.ndarray, group: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes ``at`` within groups (sorted ascending): bottom-up mergesort, stable.

    Every level merges neighbouring runs of all groups at once: an element's place is its rank in its
    own run plus its rank in the other, found by binary search with the hash comparison.
    """
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    inv = K.powers(len(c))[1]
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(begin, n))
    base, size = np.repeat(begin, size), np.repeat(size, size)
    where = np.arange(n) - base
    run = 1
    while run < size.max():
        pair = where // (2 * run) * (2 * run)
        left = where - pair < run
        o_lo = np.where(left, pair + run, pair)
        o_hi = np.minimum(np.where(left, pair + 2 * run, pair + run), size)
        lo, hi = np.minimum(o_lo, size), np.maximum(o_hi, np.minimum(o_lo, size))
        first = lo.copy()
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                break
            mid = (lo[on] + hi[on]) // 2
            a, b = at[order[on]], at[order[base[on] + mid]]
            k = lcp(c, inv, a, b, most)
            full = k >= most
            x, y = data[np.minimum(a + k, len(data) - 1)], data[np.minimum(b + k, len(data) - 1)]
            # from the left run: others before it are smaller; from the right run: others before it are not larger
            before = np.where(full, ~left[on], y < x)
            lo[on] = np.where(before, mid + 1, lo[on])
            hi[on] = np.where(before, hi[on], mid)
        own = where - np.where(left, pair, pair + run)
        place = base + pair + own + (lo - first)
        moved = np.empty(n, np.int64)
        moved[place] = order
        order = moved
        run *= 2
    return order


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes at a and at b are the same, row by row."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 13):
        m = n[i : i + (1 << 13)]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        differ = data[np.repeat(a[i : i + (1 << 13)], m) + step] != data[np.repeat(b[i : i + (1 << 13)], m) + step]
        if differ.any():
            out[i + np.repeat(np.arange(len(m)), m)[differ]] = False
    return out


def repeats(group: np.ndarray, data: np.ndarray, offs: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, from, to) byte ranges within contexts that repeat an earlier string.

    group: sorted; high: offset of the anchor in its first window; rank: order of the rows' strings.
    """
    size = np.diff(offs)
    c = K.prefix_hash(data)
    inv = K.powers(len(c))[1]
    whole = K.mix((c[offs[1:]] - c[offs[:-1]]) * inv[offs[:-1]] + size.astype(np.uint64))
    order = np.lexsort((rank, whole, size, high, group))
    g, hi_, sz, w = group[order], high[order], size[order], whole[order]
    same = (g[1:] == g[:-1]) & (hi_[1:] == hi_[:-1]) & (sz[1:] == sz[:-1]) & (w[1:] == w[:-1])
    k = np.flatnonzero(same)
    same[k] = equal_bytes(data, offs[order[k]], offs[order[k + 1]], sz[k])
    copy = np.concatenate(([False], same))
    rows = order[copy]
    out = [(rows, np.zeros(len(rows), np.int64), size[rows])]
    only = np.sort(order[~copy])
    g = group[only]
    more = np.zeros(len(only), bool)
    more[1:] |= g[1:] == g[:-1]
    more[:-1] |= g[1:] == g[:-1]
    only = only[more]
    if not len(only):
        return out
    n = size[only] - length + 1  # windows
    row = np.repeat(only, n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, o = offs[row] + j, high[row] - j
    order = np.lexsort((rank[row], o, group[row]))
    row, j, at, o = row[order], j[order], at[order], o[order]
    new = np.concatenate(([True], (group[row][1:] != group[row][:-1]) | (o[1:] != o[:-1])))
    key = np.cumsum(new)
    lone = np.bincount(key)[key] == 1
    row, j, at, key = row[~lone], j[~lone], at[~lone], key[~lone]
    if not len(row):
        return out
    order = suffix_sort(data, c, key, at, length)
    row, j, at, key = row[order], j[order], at[order], key[order]
    near = np.flatnonzero(key[1:] == key[:-1])
    hit = near[lcp(c, inv, at[near], at[near + 1], length) >= length]
    hit = hit[equal_bytes(data, at[hit], at[hit + 1], np.full(len(hit), length))]
    twin = np.zeros(len(row), bool)
    twin[hit + 1] = True  # stable sort by rank: the first of a class is the earliest
    rows, js = row[twin], j[twin]
    order = np.lexsort((js, rows))
    rows, js = rows[order], js[order]
    if len(rows):
        brk = np.concatenate(([True], (rows[1:] != rows[:-1]) | (js[1:] != js[:-1] + 1)))
        a = np.flatnonzero(brk)
        b = np.append(a[1:], len(rows)) - 1
        out.append((rows[a], js[a], js[b] + length))
    return out


def _anchor_rows(length: int):
    def emit(source):
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush():
            h, mark, packed = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, mark, packed = h[order], mark[order], packed[order]
            first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            f = np.flatnonzero(first)
            differs = np.zeros(len(f), bool)
            other = (mark != mark[f][group]) | (packed >> 14 != packed[f][group] >> 14)
            differs[group[other]] = True
            sure = differs[group]
            lead = f[differs]  # one row of a known repeat still meets the other tasks' rows
            # rows meet by hash; a known repeat keeps its hash aside and is dealt out by its place
            own = K.i64(h)
            apart = K.i64(K.mix(mark.view(np.uint64) ^ K.mix(packed.view(np.uint64))))
            cols = [np.concatenate((np.where(sure, apart, own), own[lead])), np.concatenate((mark, mark[lead])), np.concatenate((packed, packed[lead])), np.concatenate((own, own[lead]))]
            bare = np.concatenate((~sure, np.ones(len(lead), bool)))
            for a in range(0, len(bare), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[b]) for x in cols[:3]), pa.array(cols[3][b], mask=bare[b])], ["meet", "mark", "packed", "sure_h"])

        for data, offs, more in K.batches(source, "text", "mark"):
            marks = more["mark"].to_numpy()
            for d in np.flatnonzero(np.diff(offs) >= length):
                h, p, a, b = anchors(data[offs[d] : offs[d + 1]], length)
                held.append((h, np.full(len(h), marks[d]), p << 14 | (p - a) << 7 | (b - a)))
                count += len(h)
            if count > 1 << 18:
                yield from flush()
                count = 0
        if held:
            yield from flush()

    return emit


def repeated_contexts(h, part, doc, mark, place, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which contexts equal one that starts earlier in the batch, so repeat it from end to end."""
    n = np.diff(off)
    c = K.prefix_hash(data)
    whole = K.mix((c[off[1:]] - c[off[:-1]]) * K.powers(len(c))[1][off[:-1]] + n.astype(np.uint64))
    same_kind = K.mix(h.view(np.uint64) + K.mix(part.view(np.uint64) + (place & 127).astype(np.uint64)))
    order = np.lexsort((place >> 7, mark, doc, whole ^ same_kind))
    x, y = order[1:], order[:-1]
    same = np.logical_and.reduce([v[x] == v[y] for v in (whole, n, h, part, place & 127)])
    k = np.flatnonzero(same)
    same[k] = equal_bytes(data, off[x[k]], off[y[k]], n[x[k]])
    elsewhere = (doc[x] != doc[y]) | (mark[x] != mark[y]) | (place[x] != place[y])  # a row met twice repeats nothing
    gone = np.zeros(len(h), bool)
    gone[x[same & elsewhere]] = True
    return gone


def pieces(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes of n-byte pieces, and the offsets of the pieces once gathered."""
    off = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(begin - off[:-1], n) + np.arange(off[-1]), off


def dealt_out(h, doc, mark, place, step, begin, n, data: np.ndarray, c: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Contexts split by blocks of ``step`` offsets: h, part (hash of the bytes all windows of the block share), doc, mark, place, begin, n."""
    hi, more = place & 127, n - length
    low = (hi - more) // step
    m = hi // step - low + 1
    r = np.repeat(np.arange(len(h)), m)
    block = (low[r] + np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)) * step[r]
    last = block + step[r] - 1
    o_hi, o_lo = np.minimum(hi[r], last), np.maximum(hi[r] - more[r], block)
    pos = begin[r] + hi[r]
    a, b = pos - block, pos - last + length
    core = K.mix((c[b] - c[a]) * K.powers(len(c))[1][a] + block.astype(np.uint64))
    return h[r], K.i64(core), doc[r], mark[r], (place[r] >> 7) + hi[r] - o_hi << 7 | o_hi, pos - o_hi, o_hi - o_lo + length


def merged(doc, mark, a, b) -> tuple[np.ndarray, ...]:
    """Ranges by document, overlapping and touching ones as one."""
    order = np.lexsort((a, mark, doc))
    doc, mark, a, b = doc[order], mark[order], a[order], b[order]
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))[: len(a)]
    shift = np.cumsum(other) * (int(b.max(initial=0)) + 1)
    reach = np.maximum.accumulate(b + shift) - shift
    new = other.copy()
    new[1:] |= a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], mark[first], a[first], reach[np.append(first[1:], len(a))[: len(first)] - 1]


def settled(h, doc, mark, place, step, data: np.ndarray, off: np.ndarray, length: int):
    """Context rows of a batch, aggregated first: of equal contexts the earliest keeps its bytes.

    What is left of frequent anchors is dealt out, and equal pieces are settled again, in portions of
    PORTION bytes. The others repeat an earlier one from end to end: a document's ranges of that kind
    are merged, have no bytes any more, their length stands in ``part``, and they are dealt out by place.
    """
    columns = ["h", "part", "doc", "mark", "place", "ctx"]
    n = np.diff(off)
    nothing = np.zeros(len(h), np.int64)
    gone = repeated_contexts(h, nothing, doc, mark, place, data, off)
    over = [(doc[gone], mark[gone], place[gone] >> 7, (place[gone] >> 7) + n[gone])]

    def rows(keep, h, part, doc, mark, place, begin, n):
        at, to = pieces(begin[keep], n[keep])
        ctx = pa.Array.from_buffers(pa.binary(), len(to) - 1, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data[at])])
        return pa.RecordBatch.from_arrays([*(pa.array(v[keep]) for v in (h, part, doc, mark, place)), ctx], columns)

    yield rows(~gone & (step == 0), h, nothing, doc, mark, place, off[:-1], n)
    hot = np.flatnonzero(~gone & (step > 0))
    if len(hot):
        hot = hot[np.argsort(h[hot], kind="stable")]
        c = K.prefix_hash(data)
        size = np.cumsum((n[hot] - length) // step[hot] * length + 2 * n[hot])
        for k in np.split(hot, np.flatnonzero(np.diff(size // PORTION)) + 1):
            got = dealt_out(h[k], doc[k], mark[k], place[k], step[k], off[:-1][k], n[k], data, c, length)
            at, to = pieces(*got[5:])
            gone = repeated_contexts(*got[:5], data[at], to)
            yield rows(~gone, *got)
            start = got[4][gone] >> 7
            over.append((got[2][gone], got[3][gone], start, start + got[6][gone]))
    doc, mark, a, b = merged(*(np.concatenate(x) for x in zip(*over, strict=True)))
    apart = K.i64(K.mix((doc ^ (a << 27)).view(np.uint64)))
    yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (apart, b - a, doc, mark, a << 7)), pa.nulls(len(a), pa.binary())], columns)


def _contexts(length: int):
    def emit(source):
        cols: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
        held = 0

        def flush():
            *keys, texts, sizes = (np.concatenate(c) for c in cols)
            for c in cols:
                c.clear()
            yield from settled(*keys, texts, np.concatenate(([0], np.cumsum(sizes))), length)

        for batch in source:
            raw, offs = K.text_arrays(batch.column("text"))
            doc, mark = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            lists = (batch.column(c) for c in ("packed", "hs", "heavy"))
            for d, lists_of in enumerate(zip(*lists, strict=True)):
                packed, hs, heavy = (x.values.to_numpy() for x in lists_of)
                t = raw[offs[d] : offs[d + 1]]
                for i in range(0, len(packed), 1 << 12):  # a long text's anchors, a portion at a time
                    p, h, step = (x[i : i + (1 << 12)].astype(np.int64) for x in (packed, hs, heavy))
                    hi, n = p >> 7 & 127, (p & 127) + length
                    s = (p >> 14) - hi
                    at, _ = pieces(s, n)
                    for c, v in zip(cols, (h, np.full(len(h), doc[d]), np.full(len(h), mark[d]), s << 7 | hi, step, t[at], n), strict=True):
                        c.append(v)
                    held += len(at)
                    if held > PORTION:
                        yield from flush()
                        held = 0
        if held:
            yield from flush()

    return emit


def _ranges(length: int):
    def solve(t: pa.Table):
        data, offs = K.text_arrays(t.column("ctx").combine_chunks())
        h, part, doc, mark, place = (t.column(c).combine_chunks().to_numpy() for c in ("h", "part", "doc", "mark", "place"))
        s = place >> 7
        group = np.cumsum(np.concatenate(([False], (h[1:] != h[:-1]) | (part[1:] != part[:-1]))))
        # strings at one offset from their anchors start in the order of the anchors
        pos = s + (place & 127)
        order = np.lexsort((pos, mark, doc, group))
        twice = np.zeros(len(order), bool)  # rows equal in id and text
        twice[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (pos, mark, doc, group)])
        if twice.any():
            yield from solve(t.filter(pa.array(~twice)))
            return
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        got = repeats(group, data, offs, place & 127, rank, length)
        row, a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(mark[row]), pa.array(s[row] + a), pa.array(s[row] + b)], ["doc", "mark", "a", "b"])

    def emit(source):
        held, size = [], 0
        for batch in source:  # sorted by (h, part): groups are whole between key changes
            if batch.column("ctx").null_count:
                bare = batch.filter(batch.column("ctx").is_null())
                s = bare.column("place").to_numpy() >> 7
                yield pa.RecordBatch.from_arrays([bare.column("doc"), bare.column("mark"), pa.array(s), pa.array(s + bare.column("part").to_numpy())], ["doc", "mark", "a", "b"])
                batch = batch.filter(batch.column("ctx").is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > 1 << 19:
                t = pa.Table.from_batches(held).combine_chunks()
                h, part = t.column("h").to_numpy(), t.column("part").to_numpy()
                brk = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]))
                if len(brk):
                    k = int(brk[-1]) + 1
                    yield from solve(t.slice(0, k))
                    held = t.slice(k).to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return emit


def _kept(cut_text: bool):
    def emit(source):
        for batch in source:
            raw, offs = K.text_arrays(batch.column("text"))
            n, removed, spans, sha, texts = [], [], [], [], []
            for d, (whole, rs) in enumerate(zip(batch.column("whole").to_pylist(), batch.column("ranges"), strict=True)):
                t = raw[offs[d] : offs[d + 1]]
                gone = np.zeros(len(t) + 1, np.int32)
                if whole:
                    gone[0] += 1
                    gone[-1] -= 1
                elif rs.is_valid and len(rs.values):
                    v = rs.values
                    np.add.at(gone, v.field(0).to_numpy(), 1)
                    np.add.at(gone, v.field(1).to_numpy(), -1)
                off = np.cumsum(gone[:-1]) > 0
                left = t[~off].tobytes()
                n.append(len(t))
                removed.append(int(off.sum()))
                spans.append(int((off & ~np.concatenate(([False], off[:-1]))).sum()) if len(off) else 0)
                sha.append(hashlib.sha256(left).hexdigest())
                if cut_text:
                    texts.append(left.decode("utf-8", "ignore"))
            cols = {"row": batch.column("row"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if cut_text:
                cols["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return emit


def dedup_substrings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, length: int = 100, cut_text: bool = False) -> DataFrame:
    """``keep`` columns as struct ``row``, with n_bytes, n_removed, n_spans, kept_sha256 (and kept_text)."""
    if not 100 <= length <= 100 + 20:
        raise ValueError("anchors are laid out for strings of 100 to 120 bytes")
    keep = keep if keep is not None else docs.columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LEAST)).alias("doc"), F.xxhash64(body).alias("mark"), body.alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
    )
    exact = F.unhex(F.sha2("text", 256)).alias("sha")
    keyed = base.where(F.octet_length("text") >= length).select("doc", "mark", exact)
    texts = cut(keyed.groupBy("mark", "sha").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")))
    rows = base.select("text", "mark").mapInArrow(_anchor_rows(length), "meet bigint, mark bigint, packed bigint, sure_h bigint")
    w = Window.partitionBy("meet")
    differ = (F.min("mark").over(w) != F.max("mark").over(w)) | (F.min("packed").over(w) != F.max("packed").over(w))
    repeated = cut(rows.withColumn("differ", differ).where("sure_h is not null or differ").select(F.coalesce("sure_h", "meet").alias("h"), "mark", "packed"))
    # hashes with many rows, written first: the engine broadcasts them where they are few, else it merges two plain
    # shuffles and deals a hash's rows out
    n = F.col("count")
    heavy = cut(repeated.groupBy("h").count().where(n > HEAVY).select("h", F.when(n > VERY_HEAVY, 1).otherwise(BLOCK).alias("step")))
    by_text = (
        repeated.join(heavy, "h", "left").groupBy("mark")
        .agg(F.collect_set(F.struct("packed", "h", F.coalesce("step", F.lit(0)).alias("step"))).alias("x"))
        .select("mark", F.col("x.packed").alias("packed"), F.col("x.h").alias("hs"), F.col("x.step").alias("heavy"))
        .join(texts.groupBy("mark").agg(F.min("first_doc").alias("doc")), "mark")
    )
    contexts = by_text.join(base.select("doc", "mark", "text").dropDuplicates(["doc", "mark"]), ["doc", "mark"])
    contexts = contexts.select("doc", "mark", "text", "packed", "hs", "heavy").mapInArrow(_contexts(length), "h bigint, part bigint, doc bigint, mark bigint, place bigint, ctx binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = contexts.repartition(parts, "h", "part").sortWithinPartitions("h", "part").mapInArrow(_ranges(length), "doc bigint, mark bigint, a bigint, b bigint")
    ranges = cut(ranges)
    release(repeated, heavy)
    ranges = ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    # only texts that several ids have; a copied text's rows may be many, and the join writes nothing wide
    copied = texts.where("first_doc < last_doc").drop("last_doc")
    later = keyed.join(copied, ["mark", "sha"]).where("first_doc < doc").select("doc", "mark").distinct().withColumn("whole", F.lit(True))
    lost = later.join(ranges, ["doc", "mark"], "full")
    judged = base.join(lost, ["doc", "mark"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    row = base.schema["row"].dataType.simpleString()
    schema = f"row {row}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * cut_text
    return judged.select("row", "text", "whole", "ranges").mapInArrow(_kept(cut_text), schema)
