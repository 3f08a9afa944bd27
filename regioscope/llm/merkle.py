"""Merkle manifest of a dataset: leaves, roots and authentication paths by fractal traversal.

A leaf is the SHA-256 of a row's fields. Per group (source) the leaves ascend by key and every 16 neighbours
become one node, level by level, until one is left; the groups' roots, in order of the group, go on
likewise to one root. Digests enter a hash as hex text.

Leaves are ranked by a range sort and a prefix sum over its partitions, and cut into aligned blocks of 16 ** 3.
One task streams whole blocks. It keeps, for each of a block's levels, the run of nodes that
holds the current leaf (existing) and the run that comes next (desired), which a tree hash builds from one leaf
for each leaf that passes, as many leaves ahead as the run is wide. When the last leaf of a run has passed, the desired run takes
its place. So each leaf's path is at hand with at most 32 digests a level, besides the block's own leaves.
The blocks' roots are the leaves of the next forest, which is cut into blocks in the same way, and so on to the root; the paths come
down again, one row for each block that leads its leaves as a header: a path of kilobytes never goes through a shuffle row by row.

Edge cases: a null field reads as ``-`` (an empty text as ``0:``); null keys come first, null groups too; equal keys follow each other
in the order of their leaves, and equal rows have places of their own; a group of one row has its leaf as root; texts of any
length are hashed where they are read; columns not named as fields play no part, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from binascii import hexlify, unhexlify
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

ARITY = 16
LEVELS = 3
BLOCK = ARITY**LEVELS
#: Rows of the table of partition offsets (some 60 bytes each) up to which it is broadcast.
OFFSETS = 100_000


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Hex digest of a row's fields."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def _join(run: list[bytes]) -> bytes:
    return sha256(b"".join(run)).hexdigest().encode()


def height(total: int) -> int:
    """Levels that a block rises: to the root of a tree that is one block, else all."""
    if total > BLOCK:
        return LEVELS
    h = 0
    while ARITY**h < total:
        h += 1
    return h


class Treehash:
    """Builds nodes of one level from leaves that are fed in order; below it at most a run a level is held."""

    def __init__(self, level: int):
        self.nodes: list[bytes] = []
        self.parts: list[list[bytes]] = [[] for _ in range(level)]

    def _put(self, j: int, node: bytes) -> None:
        while j < len(self.parts):
            self.parts[j].append(node)
            if len(self.parts[j]) < ARITY:
                return
            node, self.parts[j] = _join(self.parts[j]), []
            j += 1
        self.nodes.append(node)

    def feed(self, node: bytes) -> None:
        self._put(0, node)

    def finish(self) -> list[bytes]:
        """The nodes, the last of short runs included."""
        for j, part in enumerate(self.parts):
            if part:
                self.parts[j] = []
                self._put(j + 1, _join(part))
        return self.nodes


def traverse(leaves: list[bytes], levels: int) -> Iterator[tuple[list[list[bytes]], list[int]]]:
    """For each leaf: the run that holds its ancestor on each level, from below, and the ancestor's place in it."""
    width = [ARITY ** (i + 1) for i in range(levels)]
    existing, desired = [], []
    for i in range(levels):
        first = Treehash(i)
        for x in leaves[: width[i]]:
            first.feed(x)
        existing.append(first.finish())
        desired.append(Treehash(i))
    for t in range(len(leaves)):
        yield existing, [t * ARITY // w % ARITY for w in width]
        for i, w in enumerate(width):
            if t + w < len(leaves):
                desired[i].feed(leaves[t + w])
            if (t + 1) % w == 0:
                existing[i], desired[i] = desired[i].finish(), Treehash(i)


def block_root(leaves: list[bytes], levels: int) -> bytes:
    top = Treehash(levels)
    for x in leaves:
        top.feed(x)
    return top.finish()[0]


def packed(runs: list[list[bytes]], places: list[int]) -> bytes:
    """A path as bytes: for each level the place in its run, the number of siblings, the siblings."""
    out = []
    for run, k in zip(runs, places, strict=True):
        out += [bytes((k, len(run) - 1)), unhexlify(b"".join(run[:k] + run[k + 1 :]))]
    return b"".join(out)


def unpacked(path: bytes) -> list[tuple[int, bytes]]:
    """(place, siblings as hex text) for each level of a packed path."""
    out, at = [], 0
    while at < len(path):
        k, n = path[at], path[at + 1]
        out.append((k, hexlify(path[at + 2 : at + 2 + 32 * n])))
        at += 2 + 32 * n
    return out


def fold(node: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a node has with the siblings of its path."""
    for k, siblings in steps:
        node = sha256(siblings[: 64 * k] + node + siblings[64 * k :]).hexdigest().encode()
    return node


def _blocks(source, names: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """((tree, block), columns) for each block of a stream of batches that is sorted by block."""
    key, held = None, {c: [] for c in names}
    for batch in source:
        cols = {c: batch.column(c).to_pylist() for c in ["tree", "block", *names]}
        keys = list(zip(cols["tree"], cols["block"], strict=True))
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if keys[a] != key:
                if key is not None:
                    yield key, held
                key, held = keys[a], {c: [] for c in names}
            for c in names:
                held[c] += cols[c][a:b]
            a = b
    if key is not None:
        yield key, held


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """tree, pos, block and total for nodes of many trees, ranked in the given order; the nodes are written twice, in order the second time."""
    base = cut(nodes)
    ordered = cut(base.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    release(base)
    per = ordered.groupBy("tree", "part").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = cut(per.select("tree", "part", (before - F.col("lo")).alias("shift"), F.sum("n").over(tree).alias("total")))
    joined = ordered.join(F.broadcast(per) if per.count() <= OFFSETS else per, ["tree", "part"])
    pos = F.col("at") + F.col("shift")
    return joined.withColumn("pos", pos).withColumn("block", F.floor(pos / BLOCK).cast("bigint")).drop("at", "part", "shift")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _roots(nodes: DataFrame) -> DataFrame:
    """The roots of all blocks, as nodes of the next forest."""

    def run(source):
        out: list[tuple] = []
        for (tree, block), cols in _blocks(source, ["digest", "total"]):
            total = cols["total"][0]
            root = block_root([hexlify(x) for x in cols["digest"]], height(total))
            out.append((tree, block, -(-total // BLOCK), unhexlify(root), block // BLOCK))
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out):
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["tree", "pos", "total", "digest", "block"])

    return _dealt(nodes.select("tree", "block", "pos", "total", "digest")).mapInArrow(run, "tree string, pos bigint, total bigint, digest binary, block bigint")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(forests from below, one row a tree with its root)."""
    forests = [nodes]
    while True:
        up = cut(_roots(forests[-1]))
        if up.agg(F.max("total")).first()[0] in (None, 1):
            return forests, up.select("tree", "digest")
        forests.append(up)


def _led(nodes: DataFrame, uppers: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of each block, after a header row (pos -1) with the path of the block's root."""
    blank = {"upper": F.lit(None).cast("binary"), "subroot": F.lit(None).cast("binary")}
    rows = nodes.select("tree", "block", "pos", "total", "digest", *carried).withColumns(blank)
    heads = uppers.select("tree", "block", F.lit(-1).cast("bigint").alias("pos"), "upper", "subroot")
    return _dealt(rows.unionByName(heads, allowMissingColumns=True))


def _paths(nodes: DataFrame, uppers: DataFrame, name: str | None = None) -> DataFrame:
    """tree, block, upper, subroot: the path of every node, which the block it is the root of takes as its header.

    With ``name``, the nodes are roots of trees of that name, so they lead block 0 of it.
    """

    def run(source):
        for (tree, _), cols in _blocks(source, ["pos", "total", "digest", "upper", "subroot", *([name] if name else [])]):
            upper, subroot, total = cols["upper"][0], cols["subroot"][0], cols["total"][1]
            digests = cols["digest"][1:]
            paths = [packed(*x) + upper for x in traverse([hexlify(x) for x in digests], height(total))]
            n = len(paths)
            trees, blocks, subroots = (cols[name][1:], [0] * n, digests) if name else ([tree] * n, cols["pos"][1:], [subroot] * n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.string()), pa.array(blocks, pa.int64()), pa.array(paths, pa.binary()), pa.array(subroots, pa.binary())], ["tree", "block", "upper", "subroot"]
            )

    return _led(nodes, uppers, [name] if name else []).mapInArrow(run, "tree string, block bigint, upper binary, subroot binary")


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None, with_path: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified (and the packed path) for every row.

    ``altered`` gives fields as they are found now, where the manifest is of the rows as they were: the
    folded root then comes from the leaf of the fields as found, with the siblings as they were.
    """
    spark = docs.sparkSession
    of = {c: F.col(f"`{c}`") for c in fields}
    was = leaf(*of.values())
    now = leaf(*(of | altered).values()) if altered else was
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(f"`{key}`").cast("bigint").alias("id"), F.unhex(was).alias("digest"), F.unhex(F.when(now != was, now)).alias("found"))
    leaves = _placed(rows, ["id", "digest"])
    forests, tops = _climb(leaves)
    schema = "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string, path binary"
    groups = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    over, top = _climb(groups)
    top = top.first()
    root = bytes(top.digest).hex() if top else None
    uppers = spark.createDataFrame([("", 0, b"", None)] if top else [], "tree string, block bigint, upper binary, subroot binary")
    for forest in over[:0:-1]:
        uppers = _paths(forest, uppers)
    uppers = _paths(groups, uppers, "name")
    for forest in forests[:0:-1]:
        uppers = _paths(forest, uppers)

    def run(source):
        for _, cols in _blocks(source, ["id", "total", "digest", "found", "upper", "subroot"]):
            upper, subroot, total = cols["upper"][0], cols["subroot"][0].hex(), cols["total"][1]
            above = unpacked(upper)
            tail = b"".join(siblings for _, siblings in above)
            ends: dict[bytes, bytes] = {}  # what a block's root folds to; nearly all leaves have the same
            leaves = [hexlify(x) for x in cols["digest"][1:]]
            out = []
            for x, found, i, (runs, places) in zip(leaves, cols["found"][1:], cols["id"][1:], traverse(leaves, height(total)), strict=True):
                steps = [(k, b"".join(run[:k] + run[k + 1 :])) for run, k in zip(runs, places, strict=True)]
                proof = sha256(b"".join([s for _, s in steps]) + tail).hexdigest()
                mine = fold(hexlify(found) if found else x, steps)
                if mine not in ends:
                    ends[mine] = fold(mine, above)
                out.append((i, x.decode(), subroot, proof, ends[mine].decode(), packed(runs, places) + upper if with_path else None))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        types = [pa.int64(), *[pa.string()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["id", "leaf", "subroot", "proof_sha256", "folded_root", "path"])

    got = _led(leaves, uppers, ["id", "found"]).mapInArrow(run, schema)
    return got.select(
        F.col("id").alias(key), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"), *(["path"] if with_path else []),
    )
