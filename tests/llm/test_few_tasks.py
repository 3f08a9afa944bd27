"""Small steps run in few tasks, whatever the session's shuffle partitions; small tables are broadcast, large ones shuffled, with equal results."""

import random

import brute
import pytest
from regioscope.llm import common, jaccard

MANY = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def tasks(spark, group, run):
    """What a call returns, and how many tasks it ran."""
    spark.sparkContext.setJobGroup(group, group)
    got, told = run(), spark.sparkContext.statusTracker()
    jobs = [told.getJobInfo(j) for j in told.getJobIdsForGroup(group)]
    stages = {s: told.getStageInfo(s) for j in jobs if j for s in j.stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, sum(s.numCompletedTasks for s in stages.values() if s)


def near_copies():
    """Copies, near copies of one text in many sizes, unlike texts with a passage on all of them."""
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage, long = words(24), words(120)
    texts = [passage + words(4 + k % 9) for k in range(130)] + [[*long[: 120 - k], *words(k)] for k in range(40)]
    texts += [long] * 30 + [words(30) for _ in range(20)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_components_in_few_tasks(many_partitions):
    edges = many_partitions.createDataFrame([(i, i + 1) for i in range(0, 60)] * 2 + [(100, 200 + i) for i in range(50)], "a bigint, b bigint")
    got, n = tasks(many_partitions, "components", lambda: dict(common.components(edges, "a", "b").collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert n < 400


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_classes_in_few_tasks(many_partitions, monkeypatch, broadcast):
    monkeypatch.setattr(common, "LOOKUP_ROWS", broadcast)
    rows = near_copies()
    df = many_partitions.createDataFrame(rows, "doc_id bigint, text string").coalesce(4)
    got, n = tasks(many_partitions, f"classes {broadcast}", lambda: jaccard.jaccard_classes(df, block=8).collect())
    assert {r.doc: (r.n_shingles, r.component) for r in got} == brute.jaccard(rows)
    assert n < 2_000
