"""Near-duplicate classes in large groups: copies in many tasks, shared passages in unlike texts, near misses."""

import random

import numpy as np
import pytest

import brute
from regioscope.llm import jaccard, pipeline


def words(rnd, n):
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


def test_a_node_counts_once(spark):
    """Copies of one text in many tasks are one node: their shingles are neither shared nor frequent."""
    rows = [(1, 0, 7, 1)] * 200 + [(2, 0, 7, 1), (2, 0, 8, 1), (2, 0, 7, 1)] + [(3, 5, 7, 1)] * 2
    postings = spark.createDataFrame(rows, "tok bigint, salt int, node bigint, nm bigint").repartition(4)
    got = sorted((r.tok, r.node, r.df) for r in jaccard.met(postings).collect())
    assert got == [(2, 7, 2), (2, 8, 2), (3, 7, jaccard.LIMIT + 1)]


def test_no_star_without_enough_frequent_shingles(spark):
    """Nodes that need more matches than they reach on frequent shingles are not connected by those."""
    rows = [(1, node, 2 << 32 | 50, 200) for node in range(200)]
    posted = spark.createDataFrame(rows, "tok bigint, node bigint, nm bigint, df int")
    assert jaccard.candidates(posted, 80)[1].count() == 0
    rows[5] = (1, 5, 1 << 32 | 50, 200)  # one match is enough for this node, so for all pairs with it
    posted = spark.createDataFrame(rows, "tok bigint, node bigint, nm bigint, df int")
    assert len({x for r in jaccard.candidates(posted, 80)[1].collect() for x in r}) == 200


@pytest.mark.parametrize("n", [1, 9, 60, 700, 4000])
def test_sketches_lose_no_link(n):
    rnd = np.random.default_rng(n)
    for share in (0.8, 0.85, 0.95):
        common = -(-int(n * 200 * share / (1 + share)) // 100) + 1
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[: min(n, common)], rnd.integers(0, 2**63, max(n - common, 0)).astype(np.uint64)))
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        x = np.stack([np.minimum(np.bincount((v & np.uint64(255)).astype(int), minlength=256), 255) for v in (a, b)]).astype(np.int16)
        if 100 * inter >= 80 * union:
            assert jaccard.may_link(x[:1], x[1], np.array([len(a) + len(b)]), 80).all()


def test_blocks_with_many_close_pairs_go_whole():
    x = np.zeros((20, 256), np.int16)
    x[:, 0] = 50
    size, cls = np.full(20, 50), np.arange(20)
    one, other = slice(0, 10), slice(10, 20)
    assert jaccard.close(size, cls, x, x[:, ::4], one, other, 80, 99) is None
    assert len(jaccard.close(size, cls, x, x[:, ::4], one, other, 80, 100)) == 100
    assert len(jaccard.close(size, cls, x, x[:, ::4], one, one, 80, 100)) == 45
    assert jaccard.close(size, cls * 0, x, x[:, ::4], one, other, 80, 100) == []


@pytest.mark.parametrize("limit", [3, 96])
def test_unlike_texts_with_shared_passages(spark, monkeypatch, limit):
    """Texts with a passage in common, near misses, near copies across bands of sizes: all links and no others, and few texts sent."""
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    rnd = random.Random(5)
    passage, long = words(rnd, 30), words(rnd, 200)
    texts = [passage + words(rnd, k % 12) for k in range(150)]  # some link, some just miss
    texts += [words(rnd, 40) + passage + words(rnd, 5 * k) for k in range(30)]
    texts += [[*long[: 200 - k], *words(rnd, k)] for k in range(0, 60, 2)]
    texts += [[*long, *words(rnd, k)] for k in range(0, 60, 2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.jaccard(rows)
    for block in (8, 64):
        assert {r.doc: (r.n_shingles, r.component) for r in jaccard.jaccard_classes(df, block=block).collect()} == want


def test_only_pairs_that_may_link_have_texts_sent(spark, monkeypatch):
    """300 unlike texts in one large group: their number of texts sent does not grow with the number of blocks."""
    rnd = random.Random(6)
    passage = words(rnd, 24)  # 20 shingles on every text, and four of its own: 20 of 28 for any two
    rows = [(i, " ".join(passage + words(rnd, 4))) for i in range(300)]
    sent, old = [], jaccard.cut

    def cut(frame):
        got = old(frame)
        if frame.columns == ["grp", "bi", "bj", "node", "least"]:
            sent.append(got.count())
        return got

    monkeypatch.setattr(jaccard, "cut", cut)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard.jaccard_classes(df, block=8).collect()}
    assert got == brute.jaccard(rows) and len(sent) == 1 and sum(sent) < 600  # of 44,850 pairs; in blocks, 300 texts would go out 38 times each


def test_stage_with_a_table_repeated(spark, monkeypatch):
    """The pipeline's stage on 20 copies of a table with other ids: no shingle is taken for a shared one, the first copy stays."""
    rnd = random.Random(7)
    texts = [" ".join(words(rnd, 30)) for _ in range(40)]
    docs = spark.createDataFrame([(40 * k + i, t) for k in range(20) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    kept, old = [], jaccard.met

    def met(postings):
        got = old(postings)
        kept.append(got.count())
        return got

    monkeypatch.setattr(jaccard, "met", met)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()) == list(range(40))
    assert kept == [0]
