"""Closed forms of the distribution measures, nulls, ties and guards."""

import math

import pytest
from pyspark.sql import functions as F

from regioscope.functions import measures as M


def one(spark, y, w=None):
    rows = [("g", float(v) if v is not None else None, float(x)) for v, x in zip(y, w or [1] * len(y))]
    df = spark.createDataFrame(rows, "g string, y double, w double")
    return M.index_family(df, ["g"], "y", "w" if w else None).first()


def test_two_points(spark):
    assert one(spark, [1, 3]).gini == pytest.approx(0.25)


@pytest.mark.parametrize("n", [5, 10, 24])
def test_all_in_one(spark, n):
    assert one(spark, [0] * (n - 1) + [1]).gini == pytest.approx((n - 1) / n, abs=1e-6)


def test_flat_is_zero(spark):
    r = one(spark, [4, 4, 4, 4])
    assert [r.gini, r.theil_t, r.theil_l, r.cv, r.atkinson_0_5, r.atkinson_1, r.atkinson_2] == pytest.approx([0] * 7, abs=1e-9)


def test_atkinson_is_geometric_mean(spark):
    assert one(spark, [1, 2, 4, 8]).atkinson_1 == pytest.approx(1 - 64**0.25 / 3.75, abs=1e-6)


def test_zero_refuses_logs_only(spark):
    r = one(spark, [0, 1, 2])
    assert r.theil_t is None and r.theil_l is None and r.atkinson_1 is None
    assert r.gini is not None and r.cv is not None


def test_weights_and_scale(spark):
    assert one(spark, [1, 10], [9, 1]).gini != one(spark, [1, 10], [1, 9]).gini
    a, b = one(spark, [1, 2, 7], [3, 2, 1]), one(spark, [1000, 2000, 7000], [3, 2, 1])
    assert a.gini == b.gini and a.theil_t == b.theil_t
    whole = [1, 1, 1, 2, 2, 7]
    assert one(spark, whole).gini == pytest.approx(a.gini, abs=1e-6)


def test_one_unit_or_nulls(spark):
    assert one(spark, [5]).gini is None
    assert one(spark, [None, 1, 3]).gini == pytest.approx(0.25)


def test_step_percentile_is_observed(spark):
    df = spark.createDataFrame([("g", float(i)) for i in (1, 2, 3, 4)], "g string, y double")
    r = M.ranked(df, ["g"], "y", None).groupBy("g").agg(*[M.step_percentile(q).alias(f"p{q}") for q in (10, 25, 50, 75, 90)]).first()
    assert [r.p10, r.p25, r.p50, r.p75, r.p90] == [1, 1, 2, 3, 4]


def test_tail_ratio(spark):
    df = spark.createDataFrame([("g", float(i)) for i in (1, 1, 1, 2, 2, 2)], "g string, y double")
    assert M.ranked(df, ["g"], "y", None).agg(M.tail_ratio().alias("x")).first().x == 2


def test_theil_splits(spark):
    rows = [("g", r, float(v)) for r, vs in {"a": (1, 2, 4), "b": (3, 5, 9)}.items() for v in vs]
    r = M.theil_split(spark.createDataFrame(rows, "g string, r string, y double"), ["g"], "r", "y").first()
    mu = 4
    want = sum(v / mu * math.log(v / mu) for *_, v in rows) / 6
    assert r.theil == pytest.approx(want, abs=1e-6) and r.identity_holds
    assert r.theil_between + r.theil_within == pytest.approx(r.theil, abs=2e-6)
    flat = [("g", r, float(v)) for r, vs in {"a": (1, 3), "b": (2, 2)}.items() for v in vs]
    assert M.theil_split(spark.createDataFrame(flat, "g string, r string, y double"), ["g"], "r", "y").first().theil_between == pytest.approx(0, abs=1e-9)


def test_weighted_share_and_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (None, 5.0)], "x double, w double")
    r = df.agg(M.weighted_mean(F.col("x"), F.col("w")).alias("m"), M.weighted_share(F.col("x") > 2, F.col("w")).alias("s")).first()
    assert r.m == 2.5 and r.s == pytest.approx(100 * 3 / 9)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, y double")
    assert M.index_family(df, ["g"], "y").count() == 0 and M.lorenz(df, ["g"], "y").count() == 0


def test_ranks_in_parts(spark):
    """Tiles are those of ntile, and the Gini that of all pairs, however values and ties fall into parts."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from regioscope.functions import measures as M

    rnd = random.Random(4)
    rows = [("a", float(rnd.choice([1, 2, 2, 2, rnd.random() * 50])), i, rnd.choice([0.5, 1.0, 3.0])) for i in range(700)] + [("b", float(i % 3), i, 1.0) for i in range(7)] + [("c", 5.0, 1, 2.0)] + [("d", 0.0, i, 1.0) for i in range(3)] + [("a", None, 9999, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, i int, w double")
    want = {(r.g, r.i): r.t for r in df.where("y is not null").withColumn("t", F.ntile(10).over(Window.partitionBy("g").orderBy("y", "i"))).collect()}
    for parts in (1, 4, 64):
        got = M.tiles(df, ["g"], 10, "y", "i", "t", parts)
        assert {(r.g, r.i): r.t for r in got.collect()} == want and got.columns == ["g", "y", "i", "w", "t"]
        ginis = {r.g: (r.n, r.gini) for r in M.split_gini(df, ["g"], "y", "w", parts).collect()}
        for g in "abcd":
            p = [(y, w) for k, y, _, w in rows if k == g and y is not None]
            mu, total = sum(y * w for y, w in p) / sum(w for _, w in p), sum(w for _, w in p)
            pairs = sum(w * v * abs(y - z) for y, w in p for z, v in p) / (2 * total**2 * mu) if mu and len(p) > 1 else None
            assert ginis[g][0] == len(p) and (ginis[g][1] == pytest.approx(pairs, abs=1e-12) if pairs is not None else ginis[g][1] is None)
