"""Near-duplicate classes by an exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles. All sets are ordered by one global order: shingles
known to be frequent come last, then by hash. Two sets of similarity t or more share at least m
shingles among their first |x| - ceil(t |x|) + m, for any m. Each document's m is chosen by estimated
cost: a longer prefix reads more postings, but a partner must then share m of them (of two documents'
m, the smaller one counts) before it is verified.

1. Rows with equal sets are one node (the set's 64-bit key), so copies cost one row each, whatever
   their ids. On the same pass every task tells the shingles it met often; at most MOST_FREQUENT of them
   are broadcast. They steer the order and the choice of m, never the result.
2. Prefix postings are counted by shingle. Up to LIMIT nodes on a shingle meet as pairs, counted
   across shingles and kept with enough matches and fitting sizes. On a shingle with more nodes they
   meet as star edges (each node with one that the shingle's count tells), never as pairs; a pair may
   have as many of its matches there as both prefixes reach such shingles, so fewer are asked elsewhere.
   Nodes are counted once, however many tasks met a copy of theirs; where no node has all its matches
   on such shingles, there is no star.
3. Verification reads whole texts, recomputes the sets and leaves a forest of verified links.
   What the edges connect, up to ``block`` nodes, is read once and verified in one task. In a larger
   group the counted pairs are verified one by one (a node's text beside its candidates'), so a chain
   of candidates costs what its pairs cost; and what only frequent shingles connect is dealt out in
   blocks, first each block by itself with a few common nodes, which joins near copies into one class,
   then only nodes outside the group's largest class against the others. For the latter, and for counted
   pairs, sketches of BINS bytes go out first: sets of similarity t differ in few bins, so only pairs
   that may link have their texts sent, or two blocks where that is less. No task holds a large group,
   and no link between nodes in different classes goes unchecked.
4. Components of the verified links give the classes.

What a step works on is counted first: small steps run in few tasks and look small tables up by broadcast,
so that a small or skewed table doesn't pay for a session's many shuffle partitions.

Edge cases: null text or no words: empty set, linked with nothing; fewer words than a shingle: the
whole sequence is the one shingle; a null id is never a class's smallest id (only if all its ids are
null the class has none); repeated ids and rows are rows of their own, linked by their texts alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import components, cut, few, lookup, release

LEAST = -(1 << 63)
#: A task tells shingles it met so often; the corpus calls so many frequent, and no more than these are kept.
OFTEN, FREQUENT, MOST_FREQUENT = 4, 12, 400_000
#: Nodes on one shingle that meet as pairs.
LIMIT = 96
_SEEN = 22
#: A sketch counts a set's shingles by their lowest bits; this many blocks of sketches meet as many in one task.
BINS, SKETCHES = 256, 8


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and document offsets."""
    data = K.LOWER[data]
    s, e, at = K.words(data, offs, K.BLANK)
    r, to = K.runs(K.hash_spans(data, s, e), at, n, True)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(to))
    order = np.lexsort((r, doc))
    r, doc = r[order], doc[order]
    if len(r):
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (doc[1:] != doc[:-1])))
        r, doc = r[new], doc[new]
    return r, np.searchsorted(doc, np.arange(len(offs)))


def need(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any partner: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


class Order:
    """The global order and the choice of m, from the frequent shingles and their counts."""

    def __init__(self, toks: np.ndarray, counts: np.ndarray):
        by = np.argsort(toks)
        self.toks, self.counts = toks[by], counts[by].astype(np.float64)
        self.level = (1 + np.floor(np.log2(np.maximum(self.counts, 1)))).astype(np.uint8)
        self.seen = np.zeros(1 << _SEEN, bool)
        self.seen[toks & np.uint64((1 << _SEEN) - 1)] = True

    def find(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in r that are frequent, and which they are."""
        at = np.flatnonzero(self.seen[r & np.uint64((1 << _SEEN) - 1)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.toks, r[at]), len(self.toks) - 1)
        ok = self.toks[k] == r[at]
        return at[ok], k[ok]

    def prefixes(self, r: np.ndarray, to: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ordered shingles, m, prefix length) by document."""
        size = np.diff(to)
        at, k = self.find(r)
        others = np.full(len(r), 0.1)  # what any shingle may meet by chance
        if len(at):
            level = np.zeros(len(r), np.uint8)
            level[at] = self.level[k]
            others[at] = self.counts[k]
            order = np.lexsort((r, level, np.repeat(np.arange(len(size)), size)))
            r, others = r[order], others[order]
        total = np.concatenate(([0.0], np.cumsum(others)))
        least = need(size, percent)
        short = size - least
        best, m = np.full(len(size), np.inf), np.ones(len(size), np.int64)
        for part in (0, 64, 32, 16, 12, 8):  # m: one, or this part of the set
            k = np.minimum(np.maximum(size // part if part else 1, 1), np.maximum(least, 1))
            reads = total[to[:-1] + np.minimum(short + k, size)] - total[to[:-1]]
            cost = reads + 4 * k + reads / k * size  # reading, and verifying what can match k times
            better = cost < best
            best, m = np.where(better, cost, best), np.where(better, k, m)
        return r, m, np.minimum(short + m, size)


def _keys(r: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Order-free key of each set."""
    c = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(r), dtype=np.uint64)))
    return K.i64(K.mix(c[to[1:]] - c[to[:-1]] + np.diff(to).astype(np.uint64)))


def _digest(n: int):
    """By row: id, text hash, set size and node (kind 0). By task: shingles met often, with their counts (kind 1)."""

    def emit(source):
        held, count = [], 0

        def often():
            tok, n_docs = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            at = np.flatnonzero(n_docs >= OFTEN)
            for a in range(0, len(at), 1 << 16):
                x = at[a : a + (1 << 16)]
                yield rows(1, pa.array(x * 0), pa.array(x * 0), n_docs[x], K.i64(tok[x]))

        def rows(kind, doc, th, n, node):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), doc, th, pa.array(n), pa.array(node)], ["kind", "doc", "th", "n", "node"])

        for data, offs, more in K.batches(source, "text", "doc", "th"):
            r, to = shingles(data, offs, n)
            held.append(r)
            count += len(r)
            if count > 2 << 20:
                yield from often()
                count = 0
            yield rows(0, more["doc"], more["th"], np.diff(to), _keys(r, to))
        if held:
            yield from often()

    return emit


def _postings(shared, n: int, percent: int):
    """(shingle, salt, node, set size and m) of every prefix; the node is the set's key, once for each task.

    A shingle known to be on more than LIMIT nodes is salted by its node; others have salt 0.
    """

    def emit(source):
        order: Order = shared.value
        done: set[int] = set()
        for data, offs, _ in K.batches(source, "text"):
            r, to = shingles(data, offs, n)
            node = _keys(r, to)
            r, m, p = order.prefixes(r, to, percent)
            new = np.array([not (x in done or done.add(x)) for x in node.tolist()], bool)
            p = np.where(new, p, 0)
            at = np.repeat(to[:-1] - (np.cumsum(p) - p), p) + np.arange(p.sum())
            tok, node = r[at], np.repeat(node, p)
            salt = np.zeros(len(tok), np.int32)
            hot, k = order.find(tok)
            hot = hot[order.counts[k] > LIMIT]
            salt[hot] = 1 + (node[hot] & 63)
            yield pa.RecordBatch.from_arrays([pa.array(K.i64(tok)), pa.array(salt), pa.array(node), pa.array(np.repeat(m << 32 | np.diff(to), p))], ["tok", "salt", "node", "nm"])

    return emit


def links(node: np.ndarray, r: np.ndarray, to: np.ndarray, m: np.ndarray, p: np.ndarray, left: np.ndarray, right: np.ndarray, cls: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Forest of verified links within one group: pairs of a left and a right node that are in different classes so far."""
    size = np.diff(to)
    _, first, back = np.unique(cls, return_index=True, return_inverse=True)
    root = first[back].tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # local numbers of the shingles, and postings of the prefixes
    _, local = np.unique(r, return_inverse=True)
    at = np.repeat(to[:-1] - (np.cumsum(p) - p), p) + np.arange(p.sum())
    tok, owner = local[at], np.repeat(np.arange(len(node)), p)
    by = np.argsort(tok, kind="stable")
    posts = owner[by]
    begin = np.searchsorted(tok[by], np.arange(local.max() + 2 if len(local) else 1))
    mark = np.zeros(local.max() + 1 if len(local) else 1, bool)
    out = []
    for i in range(len(node)):
        mine = local[to[i] : to[i] + p[i]]
        spans = [posts[begin[x] : begin[x + 1]] for x in mine.tolist() if begin[x + 1] - begin[x] > 1]
        if not spans:
            continue
        seen = np.bincount(np.concatenate(spans), minlength=len(node))
        seen[: i + 1] = 0
        cand = np.flatnonzero(seen)
        cand = cand[(seen[cand] >= np.minimum(m[cand], m[i])) & (100 * np.minimum(size[cand], size[i]) >= percent * np.maximum(size[cand], size[i]))]
        cand = cand[(left[i] & right[cand]) | (right[i] & left[cand])]
        if not len(cand):
            continue
        mark[local[to[i] : to[i + 1]]] = True
        for a in range(0, len(cand), 256):
            some = [j for j in cand[a : a + 256].tolist() if find(j) != find(i)]
            if not some:
                continue
            some = np.array(some)
            lens = size[some]
            flat = np.repeat(to[some] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            inter = np.add.reduceat(mark[local[flat]].astype(np.int64), np.cumsum(lens) - lens)
            for j in some[100 * inter >= percent * (lens + size[i] - inter)].tolist():
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(node[i]), int(node[j])))
        mark[local[to[i] : to[i + 1]]] = False
    return out


def _verified(shared, n: int, percent: int):
    names = ["grp", "bi", "bj"]

    def solve(t: pa.Table, order: Order):
        cols = {c: t.column(c).to_numpy() for c in ("node", "blk", "cls", *names)}
        key = np.stack([cols[c] for c in names])
        again = np.concatenate(([False], (cols["node"][1:] == cols["node"][:-1]) & (key[:, 1:] == key[:, :-1]).all(0)))
        if again.any():  # rows equal in id and text carry one node's text several times
            yield from solve(t.filter(pa.array(~again)), order)
            return
        data, offs = K.text_arrays(t.column("text").combine_chunks())
        sets = [shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n) for a, b in K.pieces(offs)]
        r = np.concatenate([x for x, _ in sets])
        to = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in sets]))])
        r, m, p = order.prefixes(r, to, percent)
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            one = slice(a, b)
            left, right = cols["blk"][one] == cols["bi"][a], cols["blk"][one] == cols["bj"][a]
            out += links(cols["node"][one], r[to[a] : to[b]], to[a : b + 1] - to[a], m[one], p[one], left, right, cols["cls"][one], percent)
        if out:
            u, v = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def emit(source):
        order: Order = shared.value
        held, size = [], 0
        for batch in source:  # sorted by group, blocks and node
            held.append(batch)
            size += batch.nbytes
            if size > 3 << 20:
                t = pa.Table.from_batches(held)
                key = np.stack([t.column(c).to_numpy() for c in names])
                brk = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
                if len(brk):
                    k = int(brk[-1]) + 1
                    yield from solve(t.slice(0, k), order)
                    held = t.slice(k).to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from solve(pa.Table.from_batches(held), order)

    return emit


def _sketched(n: int):
    """Set size and sketch (counts by bin, 255 at most) of each node."""

    def emit(source):
        for data, offs, more in K.batches(source, "text", "node"):
            r, to = shingles(data, offs, n)
            docs = len(to) - 1
            at = np.repeat(np.arange(docs), np.diff(to)) * BINS + (r & np.uint64(BINS - 1)).astype(np.int64)
            flat = np.minimum(np.bincount(at, minlength=docs * BINS), 255).astype(np.uint8)
            sketch = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(np.arange(docs + 1, dtype=np.int32) * BINS), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([more["node"], pa.array(np.diff(to)), sketch], ["node", "size", "sketch"])

    return emit


def _bins(column: pa.Array) -> np.ndarray:
    """Sketches as rows of counts."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def may_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sketches (rows) and summed sizes can be similar: bins differ by no more than the sets do."""
    return (100 + percent) * np.abs(a - b).sum(1, dtype=np.int64) <= (100 - percent) * sizes


def _screened(percent: int):
    """Counted pairs whose sketches allow a link."""

    def emit(source):
        for t in source:
            sizes = t.column("size").to_numpy() + t.column("size2").to_numpy()
            for a in range(0, t.num_rows, 1024):
                one = t.slice(a, 1024)
                ok = may_link(_bins(one.column("sketch")), _bins(one.column("sketch2")), sizes[a : a + 1024], percent)
                yield pa.RecordBatch.from_arrays([one.column(c).filter(pa.array(ok)) for c in ("node", "least")], ["node", "least"])

    return emit


def close(size: np.ndarray, cls: np.ndarray, x: np.ndarray, rough: np.ndarray, a: slice, b: slice, percent: int, most: int) -> list[tuple[int, int]] | None:
    """Places of pairs of block a and block b (each ascending by size) in different classes that may link; None if more than ``most``."""
    out = []
    lo = b.start + np.searchsorted(size[b], -(-percent * size[a] // 100), "left")
    hi = b.start + np.searchsorted(size[b], 100 * size[a] // percent, "right")
    for k, i in enumerate(range(a.start, a.stop)):
        j0, j1 = max(lo[k], i + 1) if a == b else lo[k], hi[k]
        if j0 >= j1:
            continue
        j = j0 + np.flatnonzero(may_link(rough[j0:j1], rough[i], size[j0:j1] + size[i], percent) & (cls[j0:j1] != cls[i]))
        j = j[may_link(x[j], x[i], size[j] + size[i], percent)]
        out += [(i, v) for v in j.tolist()]
        if len(out) > most:
            return None
    return out


def _close_pairs(percent: int, block: int):
    """Of sketches dealt as (grp, si, sj): pairs that may link, or (node null) two blocks that hold more than ``block`` of them."""
    names = ["grp", "si", "sj"]

    def solve(t: pa.Table):
        key = np.stack([t.column(c).to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            one = t.slice(lo, hi - lo)
            side, blk, size, cls, node = (one.column(c).to_numpy() for c in ("place", "blk", "size", "cls", "node"))
            x = _bins(one.column("sketch"))
            rough = x.reshape(len(x), -1, 4).sum(2, dtype=np.int16)
            brk = [0, *(np.flatnonzero(blk[1:] != blk[:-1]) + 1).tolist(), len(blk)]
            parts = [slice(p, q) for p, q in zip(brk[:-1], brk[1:], strict=True)]
            si, sj = key[1, lo], key[2, lo]
            for u, a in enumerate(parts):
                for b in parts[u:]:
                    if si != sj and side[a.start] == side[b.start]:
                        continue
                    got = close(size, cls, x, rough, a, b, percent, block)
                    rows = [(None, None)] if got is None else [(int(node[j]), int(node[i])) for i, j in got]
                    if rows:
                        same = [np.full(len(rows), v, np.int64) for v in (key[0, lo], blk[a.start], blk[b.start])]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, same), *(pa.array(v, pa.int64()) for v in zip(*rows, strict=True))], ["grp", "bi", "bj", "node", "least"])

    def emit(source):
        held, size = [], 0
        for batch in source:  # sorted by group, both places, block and size
            held.append(batch)
            size += batch.nbytes
            if size > 4 << 20:
                t = pa.Table.from_batches(held)
                key = np.stack([t.column(c).to_numpy() for c in names])
                brk = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
                if len(brk):
                    k = int(brk[-1]) + 1
                    yield from solve(t.slice(0, k))
                    held = t.slice(k).to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return emit


def met(postings: DataFrame) -> DataFrame:
    """Postings of shingles with two nodes or more, each node once, with their number; a salted shingle counts as one with many."""
    by = Window.partitionBy("tok", "salt")
    rows = postings.withColumn("before", F.lag("node").over(by.orderBy("node"))).where("before is null or before <> node").drop("before")
    rows = rows.withColumn("df", F.count("*").over(by))
    return rows.where("df > 1 or salt > 0").withColumn("df", F.when(F.col("salt") > 0, LIMIT + 1).otherwise(F.col("df"))).drop("salt")


def candidates(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(counted pairs, star edges), each (node, least): together they connect at least every pair that can match often enough."""
    n = rows.count()
    posts = few(rows.where(F.col("df") <= LIMIT).groupBy("tok").agg(F.collect_set(F.struct("node", "nm")).alias("x")), n)
    size = "({0}.nm & 4294967295)"
    fits = f"100 * least({size.format('a')}, {size.format('b')}) >= {percent} * greatest({size.format('a')}, {size.format('b')})"
    pair = "struct(least(a.node, b.node) as least, greatest(a.node, b.node) as node, least(shiftright(a.nm, 32), shiftright(b.nm, 32)) as m)"
    each = F.expr(f"flatten(transform(x, (a, i) -> transform(filter(slice(x, i + 2, size(x)), b -> {fits}), b -> {pair})))")
    pairs = few(posts.select(F.explode(each).alias("p")).select("p.*").groupBy("node", "least", "m").agg(F.count("*").alias("n")), n)
    many = rows.where(F.col("df") > LIMIT).select("tok", "node", F.shiftright("nm", 32).alias("m"))
    reach = cut(few(many.groupBy("node").agg(F.count("*").alias("f")), n))
    reached = reach.count()
    f = F.least(F.coalesce("f1", F.lit(0)), F.coalesce("f2", F.lit(0)))
    pairs = pairs.join(lookup(reach.withColumnRenamed("f", "f1"), reached), "node", "left")
    pairs = pairs.join(lookup(reach.select(F.col("node").alias("least"), F.col("f").alias("f2")), reached), "least", "left")
    pairs = cut(few(pairs.where(F.col("n") >= F.col("m") - f).select("node", "least"), n))
    # a pair without a match elsewhere has all on these shingles: the m of one of the two, and no fewer are reached by either
    many = cut(many.join(lookup(reach, reached), "node"))
    heads = cut(few(many.where("f >= m").groupBy("tok").agg(F.min("m").alias("fewest"), F.min("node").alias("least")), n))
    star = many.join(lookup(heads, heads.count()), "tok").where("f >= fewest and node <> least").select("node", "least").distinct()
    star = cut(few(star, n))
    release(reach, many, heads)
    return pairs, star


ROW = ["grp", "bi", "bj", "blk", "node", "cls", "text"]


def dealt_blocks(nodes: DataFrame, block: int, leaders: int = 8) -> DataFrame:
    """Large groups (grp, members, node, text) in blocks, each by itself, with a few nodes of the group in all of them."""
    nb = F.ceil(F.col("members") / F.lit(block))
    h = F.xxhash64("node")
    placed = nodes.withColumns({"nb": nb, "own": F.pmod(h, nb), "lead": (F.col("node") == F.col("grp")) | (F.pmod(F.shiftright(h, 20), F.col("members")) < leaders)})
    at = F.explode(F.when(F.col("lead"), F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).otherwise(F.array("own")))
    return placed.withColumn("blk", at).select("grp", F.col("blk").alias("bi"), F.col("blk").alias("bj"), "blk", "node", F.col("node").alias("cls"), "text")


def dealt_rest(nodes: DataFrame, classes: DataFrame, sketches: DataFrame, percent: int, block: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """What is still to be compared in large groups, nodes outside the group's largest class with all others: (nodes with their blocks, sketches as pairs of places).

    Sizes of similar sets lie in one band or in two neighbouring ones. A block holds nodes of one band, inside the
    largest class or outside; SKETCHES blocks are a place. ``rows`` is the number of rows of ``nodes``.
    """
    known = few(nodes.select("grp", "node").distinct(), rows).join(lookup(classes, classes.count()), "node", "left")
    known = cut(few(known.withColumn("cls", F.coalesce("component", "node")).drop("component"), rows))
    size = few(known.groupBy("grp", "cls").agg(F.count("*").alias("c")), rows)
    top = size.groupBy("grp").agg(F.max(F.struct("c", "cls")).alias("top"), F.sum("c").alias("members")).where("top.c < members")
    top = lookup(few(top.select("grp", F.col("top.cls").alias("main")), rows), rows)
    band = F.floor(F.log("size") / F.lit(float(np.log(100 / percent)) + 0.01)).cast("bigint")
    inside = (F.col("cls") == F.col("main")).cast("bigint")
    x = few(known.join(top, "grp").join(sketches, "node"), rows).withColumns({"band": band, "inside": inside})
    held = cut(few(x.groupBy("grp", "band", "inside").agg(F.ceil(F.count("*") / F.lit(block)).alias("nb")), rows))
    bands, blocks = held.agg(F.count("*"), F.coalesce(F.sum("nb"), F.lit(0))).first()
    at = lambda no: F.col("band") * (1 << 33) + F.col("inside") * (1 << 32) + no
    x = x.join(lookup(held, bands), ["grp", "band", "inside"]).withColumn("no", F.pmod(F.xxhash64("node"), "nb"))
    x = cut(few(x.select("grp", "node", "cls", "size", "sketch", "band", "inside", at(F.col("no")).alias("blk"), at(F.floor(F.col("no") / F.lit(SKETCHES))).alias("place")), rows))
    release(known)
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("nb") - 1) / F.lit(SKETCHES)))
    places = held.select("grp", "band", "inside", F.explode(numbers).alias("no")).withColumn("other", at(F.col("no")))
    places = places.select("grp", "other", F.col("inside").alias("beside"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    both = x.join(lookup(places, 3 * (bands + blocks // SKETCHES)), ["grp", "band"]).where("inside = 0 or beside = 0")
    dealt = both.select("grp", F.least("place", "other").alias("si"), F.greatest("place", "other").alias("sj"), "place", "blk", "size", "node", "cls", "sketch")
    dealt = few(dealt.repartition(_parts(nodes), "grp", "si", "sj"), rows * max(1, blocks // SKETCHES), 1_000)
    return x, dealt.sortWithinPartitions("grp", "si", "sj", "blk", "size")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def jaccard_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """doc (the key), n_shingles, component (the smallest key reachable by links, itself included) and cls (the class, null for an empty set) for every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).withColumn("th", F.xxhash64("text"))
    got = cut(base.mapInArrow(_digest(n), "kind int, doc bigint, th bigint, n bigint, node bigint"))
    often = got.where("kind = 1").groupBy(F.col("node").alias("tok")).agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "tok").limit(MOST_FREQUENT).toArrow()
    order = spark.sparkContext.broadcast(Order(often.column("tok").to_numpy().view(np.uint64), often.column("n").to_numpy()))
    keyed = got.where("kind = 0").select("doc", "th", "n", "node")
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    one = F.struct(F.coalesce("doc", F.lit(LEAST)).alias("doc"), "th")
    nodes = few(keyed.where("n > 0").groupBy("node").agg(F.min("doc").alias("first"), F.min(one).alias("rep")), rows)
    posted = cut(few(met(base.mapInArrow(_postings(order, n, percent), "tok bigint, salt int, node bigint, nm bigint")), total, 200_000))
    pairs, star = candidates(posted, percent)
    release(posted)
    coarse = components(pairs.union(star), "node", "least").withColumnRenamed("component", "grp")
    members = coarse.count()
    member = cut(few(nodes.select("node", "rep.*").join(lookup(coarse, members), "node"), rows))
    sizes = few(member.groupBy("grp").agg(F.count("*").alias("members")), members)
    with_text = base.withColumn("doc", F.coalesce("doc", F.lit(LEAST))).hint("merge").join(member.join(lookup(sizes, members), "grp"), ["doc", "th"])  # one plan at every size
    texts = cut(few(with_text.select("grp", "members", "node", "text"), rows, 1_000))
    zero = F.lit(0).cast("bigint")

    def verify(work: DataFrame, many: int) -> DataFrame:
        work = few(work.select(*ROW).repartition(_parts(base), "grp", "bi", "bj"), many, 1_000).sortWithinPartitions("grp", "bi", "bj", "node")
        return cut(work.mapInArrow(_verified(order, n, percent), "u bigint, v bigint"))

    work = texts.where(F.col("members") <= block).select("grp", zero.alias("bi"), zero.alias("bj"), zero.alias("blk"), "node", F.col("node").alias("cls"), "text")
    large = texts.where(F.col("members") > block).select("node", "text")
    part = lambda a: F.lit(a).cast("bigint")

    def beside(found: DataFrame, many: int, of: DataFrame) -> DataFrame:
        """Texts of pairs (node, least): each least as a head, with its nodes beside it."""
        heads = of.join(lookup(found.select(F.col("least").alias("node")), many), "node", "left_semi").select(F.col("node").alias("grp"), part(-1).alias("blk"), "node", "text")
        both = heads.union(of.join(lookup(found, many), "node").select(F.col("least").alias("grp"), part(-2).alias("blk"), "node", "text"))
        return both.select("grp", part(-2).alias("bi"), part(-1).alias("bj"), "blk", "node", F.col("node").alias("cls"), "text")

    many, beyond = members, large.count()
    if beyond:
        counted = pairs.count()
        sketches = cut(few(large.mapInArrow(_sketched(n), "node bigint, size bigint, sketch binary").dropDuplicates(["node"]), beyond))
        second = sketches.select(F.col("node").alias("least"), F.col("size").alias("size2"), F.col("sketch").alias("sketch2"))
        mine = few(few(pairs.join(sketches, "node"), counted + beyond).join(second, "least"), counted + beyond)
        screened = cut(mine.mapInArrow(_screened(percent), "node bigint, least bigint"))
        sent = screened.count()
        work = work.union(beside(screened, sent, large))
        among = components(star.join(lookup(large.select("node"), beyond), "node", "left_semi"), "node", "least").withColumnRenamed("component", "grp")
        held = few(among.groupBy("grp").agg(F.count("*").alias("members")), beyond)
        hot = cut(few(large.join(lookup(among.join(lookup(held, beyond), "grp"), beyond), "node"), beyond, 1_000))
        work = work.union(dealt_blocks(hot, block))
        many += 2 * sent
    links_found = verify(work, many)
    classes = components(links_found, "u", "v")
    if beyond:
        placed, dealt = dealt_rest(hot, classes, sketches, percent, block, beyond)
        found = cut(dealt.mapInArrow(_close_pairs(percent, block), "grp bigint, bi bigint, bj bigint, node bigint, least bigint"))
        whole, sent = found.agg(F.count_if(F.col("node").isNull()), F.count("node")).first()
        rest = beside(found.where("node is not null").select("node", "least"), sent, hot.select("node", "text"))
        if whole:
            blocks = found.where("node is null").select("grp", "bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("blk"))
            blocks = placed.select("grp", "blk", "node", "cls").join(lookup(blocks, 2 * whole), ["grp", "blk"]).join(hot.select("grp", "node", "text"), ["grp", "node"])
            rest = rest.union(blocks.select("grp", "bi", "bj", "blk", "node", "cls", "text"))
        more = verify(rest, 2 * sent + 2 * whole * block)
        if more.limit(1).count():  # else the classes stay
            classes = components(classes.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), "u", "v")
        release(hot, sketches, placed)
    release(texts, pairs, star)
    named = nodes.select("node", "first").join(lookup(classes, members), "node", "left").withColumn("cls", F.coalesce("component", "node")).drop("component")
    named = cut(few(named, rows))
    least = few(named.groupBy("cls").agg(F.min("first").alias("component")), rows)
    of = cut(few(named.select("node", "cls").join(least, "cls"), rows))
    result = keyed.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return few(result.join(of, "node", "left"), rows).select("doc", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"), "cls")
