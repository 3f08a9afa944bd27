"""Plain-Python versions of the text operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def jaccard(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    overlap = Counter()
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                overlap[ids[a], ids[b]] += 1
    for (a, b), n in overlap.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def decontaminate(docs, items, width=10):
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    win = defaultdict(set)
    for i, t in items:
        if i is None or t is None:
            continue
        w = re.findall(pat, t.translate(LOWER))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            win[tuple(w[k : k + n])].add(str(i))
    lengths = {len(x) for x in win}
    out = {}
    for i, t in docs:
        w = re.findall(pat, (t or "").translate(LOWER))
        hit, who = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in win:
                    who |= win[x]
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out


def substrings(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = hash(b[s : s + length])
            if x in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def sentences(texts, run=2, least=16, alone=50):
    """(sentences, removed sentence numbers) by text in the order of ids, from the definition."""
    docs = [[tuple(w) for x in re.split(r"[.!?\n]", t or "") if (w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOWER)))] for t in texts]
    seen, out = set(), []
    for d in docs:
        n, spans, gone = len(d), set(), set()
        words = lambda a, b: sum(map(len, d[a:b]))
        for i in range(n):
            spans |= set([(i, e) for e in range(i + run, n + 1) if words(i, e) >= least][:1])
            spans |= set([(s, i + 1) for s in range(i + 1 - run, -1, -1) if words(s, i + 1) >= least][:1])
            if len(d[i]) >= (least if n == 1 else alone):
                spans.add((i, i + 1))
        if n >= run and words(0, n) < least:
            spans.add((0, n))
        for a, b in sorted(spans):
            if (key := tuple(d[a:b])) in seen:
                gone |= set(range(a, b))
            seen.add(key)
        out.append((n, ",".join(map(str, sorted(gone)))))
    return out


def crc(ids):
    import struct

    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def kneser_ney(texts, order=4, floor=None):
    """By language: probability of a symbol after its context, from counts by the textbook recursion."""
    models = {}
    for g, ts in texts.items():
        top = Counter()
        for t in ts:
            p = " " * (order - 1) + t
            top.update(p[i - order + 1 : i + 1] for i in range(order - 1, len(p)))
        levels, now = {}, top
        for k in range(order, 0, -1):
            ones, twos = sum(v == 1 for v in now.values()), sum(v == 2 for v in now.values())
            total, kinds = Counter(), Counter()
            for x, v in now.items():
                total[x[:-1]] += v
                kinds[x[:-1]] += 1
            levels[k] = (now, ones / (ones + 2 * twos) if ones and twos else 0.5, total, kinds)
            now = Counter(x[1:] for x in now)
        models[g] = levels

    def prob(g, x, k=order):
        if k == 0:
            return floor
        n, d, total, kinds = models[g][k]
        c = x[:-1]
        if not total[c]:
            return prob(g, x[1:], k - 1)
        return max(n[x] - d, 0) / total[c] + d * kinds[c] / total[c] * prob(g, x[1:], k - 1)

    return prob


def minima(hashes, w=16):
    """(hash, position) of the least of every window, the rightmost of equals."""
    n = len(hashes)
    spans = [range(i, i + w) for i in range(n - w + 1)] or ([range(n)] if n else [])
    return sorted({max((-hashes[i], i) for i in s)[1] for s in spans})
