"""The manifest against plain recursion, the traversal against whole levels, paths against tampering."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from regioscope.llm import merkle, queries

H = lambda *x: sha256("".join(x).encode()).hexdigest()
LOWER = {c: c + 32 for c in range(65, 91)}


def text_of(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """(root, for each node its runs and places from below)."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, who = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k, of in enumerate(owners[a : a + 16]):
                for i in of:
                    paths[i].append((run, k))
            up.append(H(*run))
            who.append([i for of in owners[a : a + 16] for i in of])
        nodes, owners = up, who
    return nodes[0], paths


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars), ids not repeated."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaf = lambda r, text: H(*map(text_of, (r[0], r[3], r[2], r[4], text)))
    trees = []
    for s in order:
        rows = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0))
        trees.append((rows, *climb([leaf(r, r[1]) for r in rows])))
    root, over = climb([t[1] for t in trees])
    out = {}
    for (rows, sub, paths), above in zip(trees, over, strict=True):
        for r, path in zip(rows, paths, strict=True):
            steps = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = leaf(r, r[1].translate(LOWER) if tampered else r[1])
            for run, k in steps:
                node = H(*run[:k], node, *run[k + 1 :])
            proof = H(*[x for run, k in steps for i, x in enumerate(run) if i != k])
            out[r[0]] = (leaf(r, r[1]), sub, root, proof, node, node == root)
    return out


def result(df):
    return {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()}


def query(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(df, altered={"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower).otherwise(F.col("text"))})


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 1000, 4095, 4096])
def test_traversal(n):
    nodes = [H(str(i)) for i in range(n)]
    root, paths = climb(nodes)
    raw = [x.encode() for x in nodes]
    levels = merkle.height(n)
    assert merkle.block_root(raw, levels).decode() == root
    for i, (runs, places) in enumerate(merkle.traverse(raw, levels)):
        assert [([x.decode() for x in run], k) for run, k in zip(runs, places, strict=True)] == paths[i]
    assert i == n - 1


def test_traversal_holds_little():
    raw = [b"%064d" % i for i in range(4096)]
    for runs, _ in merkle.traverse(raw, 3):
        assert len(runs) == 3 and all(len(run) <= 16 for run in runs)


def test_blocks_and_sources(spark):
    """One source of three blocks, forty small ones, a null one, one of a single row; null fields; ids that are not dense."""
    rows = [(3 * i + 1, f"Text {i} É" if i % 11 else None, "en" if i % 3 else None, "hot", i if i % 5 else None) for i in range(9000)]
    rows += [(100_000 + i, f"A{i}", "de", f"src{i % 40}", None) for i in range(1500)]
    rows += [(200_000 + i, "", "de", None, 0) for i in range(20)] + [(None, "No id", "fr", "hot", 5), (-5, "LONE", None, "É", 4)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    got, want = result(query(df)), plain(rows)
    assert got == want
    assert sum(not x[-1] for x in got.values()) > 1500


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert result(queries.QUERIES["op12_fractal_manifest"](spark, sf)) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("tree", F.lit("x")).withColumn("block", F.lit(1))
    got = merkle.manifest(df, with_path=True).collect()
    assert len(got) == 5 and len({(r.leaf, r.proof_sha256) for r in got}) in (3, 4, 5) and all(r.verified for r in got)
    for r in got:  # every path leads its leaf to the root, and no other leaf
        steps = merkle.unpacked(bytes(r.path))
        assert merkle.fold(r.leaf.encode(), steps).decode() == r.root
        assert merkle.fold(H("other").encode(), steps).decode() != r.root
        assert H("".join(s.decode() for _, s in steps)) == r.proof_sha256
    assert merkle.manifest(df.limit(0)).count() == 0
    one = result(query(spark.createDataFrame([(7, "X", "en", "s", 1)], COLUMNS)))
    assert one == plain([(7, "X", "en", "s", 1)]) and one[7][3] == H("")


def test_any_field_counts(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(60)], COLUMNS)
    for name, other in (("lang", F.lit("de")), ("n_chars", F.lit(None).cast("bigint")), ("text", F.concat("text", F.lit(" ")))):
        assert not any(r.verified for r in merkle.manifest(df, altered={name: other}).collect())
