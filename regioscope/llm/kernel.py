"""Vectorised byte kernels shared by the text operators.

Every kernel works on one concatenated ``uint8`` buffer and document offsets, as Arrow hands them
over, so no per-row Python runs on the hot path. Hashes are 64-bit prefix polynomials modulo 2**64
(an odd base has an inverse there, so a span's hash is one subtraction and one product), finished
with an avalanche step. Callers that act on equality verify the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C1B
CHUNK = 1 << 20
#: Bytes of text that a kernel call handles at once; working arrays are about 40 times that.
BATCH_BYTES = 1 << 20

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, CHUNK + 1)
        p, q = np.full(m, BASE, np.uint64), np.full(m, pow(BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _pow, _inv = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(seg: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of a byte segment, length + 1 values."""
    c = np.zeros(len(seg) + 1, np.uint64)
    np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * powers(len(seg))[0], out=c[1:])
    return c


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most: int = BATCH_BYTES):
    """Row ranges (a, b) of about ``most`` bytes each; a longer document stands alone."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1))
        yield a, b
        a = b


def batches(source, text: str, *others: str, most: int = BATCH_BYTES):
    """For each piece of each Arrow batch: (bytes, offsets, {other column: Arrow slice})."""
    for batch in source:
        data, offs = text_arrays(batch.column(text))
        for a, b in pieces(offs, most):
            yield data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], {c: batch.column(c)[a:b] for c in others}


def table(*tables: bytes) -> np.ndarray:
    """A boolean look-up table that is true for the given bytes."""
    out = np.zeros(256, bool)
    for t in tables:
        out[list(t)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space; everything else is part of a word.
BLANK = table(b" \t\n\v\f\r")
#: Words are ASCII letters and digits and every non-ASCII byte.
ITEM_GAP = ~table(bytes(range(0x30, 0x3A)), bytes(range(0x61, 0x7B)), bytes(range(0x80, 0x100)))


def words(data: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document word offsets of maximal runs without gap bytes; runs end with their document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each of the sorted, disjoint spans; depends on a span's bytes alone."""
    out, i, n = np.empty(len(s), np.uint64), 0, len(s)
    while i < n:
        base = s[i]
        if e[i] - base > CHUNK:
            out[i] = xxhash.xxh64_intdigest(data[base : e[i]].tobytes())
            i += 1
            continue
        j = int(np.searchsorted(e, base + CHUNK, "right"))
        c = prefix_hash(data[base : e[j - 1]])
        a, b = s[i:j] - base, e[i:j] - base
        out[i:j] = mix((c[b] - c[a]) * powers(len(c))[1][a] + (b - a).astype(np.uint64))
        i = j
    return out


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values (across documents too; see ``inside``)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n] * _STEP[0]
    for j in range(1, k):
        out += (h[j : j + n] ^ np.uint64(j)) * _STEP[j % len(_STEP)]
    return mix(out)


def runs(h: np.ndarray, at: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-run inside each document and their document offsets.

    With ``short``, a document of 1 to k-1 values has its whole sequence as one run.
    """
    count = np.diff(at)
    full = np.maximum(count - k + 1, 0)
    few = (count > 0) & (count < k) if short else np.zeros(len(count), bool)
    per = np.where(few, 1, full)
    to = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(to[-1], np.uint64)
    if full.any():
        r = rolling(h, k)
        inside = np.repeat(full > 0, per)
        start = np.repeat(at[:-1] - to[:-1], per) + np.arange(to[-1])
        out[inside] = r[start[inside]]
    for d in np.flatnonzero(few):
        out[to[d]] = rolling(h[at[d] : at[d + 1]], int(count[d]))[0] ^ np.uint64(count[d])
    return out, to


def i64(x: np.ndarray) -> np.ndarray:
    """uint64 bits as Spark's signed long."""
    return x.view(np.int64)
