"""Labels, periods, pooling, and checks that stop a plan."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regioscope.operators import guard
from regioscope.operators import panel as P


def test_labels(spark):
    names = spark.createDataFrame([("Ariana",), ("Sidi Bouzid",), ("Béja",), ("Sidi",), (None,), ("123",)], "name string")
    labels = ["Ariana", "7        Ariana", "ARIANA ", "SidiBouzid", "Beja", "béja *", "Sidi Bouzid ville", "Total", "", None, "12"]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(labels)], "i int, label string, name string")
    got = [r.unit for r in P.resolve(df, names, "label", "unit").orderBy("i").collect()]
    assert got == ["Ariana", "Ariana", "Ariana", "Sidi Bouzid", "Béja", "Béja", None, None, None, None, None]
    got = [r.unit for r in P.resolve(df, names, "label", "unit", longest=True).orderBy("i").collect()]
    assert got == ["Ariana", "Ariana", "Ariana", "Sidi Bouzid", "Béja", "Béja", "Sidi Bouzid", None, None, None, None]


def test_periods(spark):
    cases = [("2019", 2019, True), ("2018/19", 2018, True), ("2018-19", 2018, True), ("19-18", 2018, True), ("00-99", 1999, True), ("24-20", 2019, False), ("2018/19", 2019, False), ("Total", 2019, False), ("", 2019, False), (None, 2019, False), ("2019", None, True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, label string, year int, want boolean")
    assert [(r.label, r.x) for r in df.select("i", "label", P.is_period(F.col("label"), F.col("year")).alias("x")).orderBy("i").collect()] == [(c[0], c[2]) for c in cases]


def test_pooling(spark):
    rows = [("a", 1, 5.0, 1, "single source"), ("a", 1, 5.0, 2, "single source"), ("a", 2, 5.0, 1, "single source"), ("b", 1, 5.0, 1, "single source"), ("b", 1, 6.0, 1, "revised"), ("c", 1, 7.0, 1, "revised"), ("c", 1, 7.0, 1, "single source"), ("d", 1, None, 1, "single source")]
    df = spark.createDataFrame(rows, "unit string, year int, value double, n_editions int, agreement string")
    got = {(r.unit, r.year): (r.value, r.n_editions, r.agreement, r.status) for r in P.pool(df, ["unit", "year"]).collect()}
    assert got == {("a", 1): (5.0, 3, "confirmed", "kept"), ("a", 2): (5.0, 1, "single source", "kept"), ("b", 1): (None, 2, None, "disputed"), ("c", 1): (7.0, 2, "revised", "kept"), ("d", 1): (None, 1, None, "disputed")}


def test_sexes_and_boundary(spark):
    rows = [("u", "m", 5.0), ("u", "f", 6.0), ("u", "b", 11.1), ("v", "m", 5.0), ("v", "f", 6.0), ("v", "b", 11.2), ("w", "m", 5.0), ("w", "b", 99.0)]
    got = P.sexes(spark.createDataFrame(rows, "unit string, indicator string, value double"), ["unit"], "m", "f", "b").collect()
    assert {r.unit for r in got if not r.fits} == {"v"}
    rows = [("i", "P", y, 9.0) for y in range(2000, 2004)] + [("i", "C", y, float(y > 2001)) for y in range(2000, 2004)] + [("j", "P", 2000, 1.0), ("k", "C", 2009, 3.0), ("k", "P", 2001, 2.0), ("k", "P", 2003, 2.0)]
    got = P.boundary(spark.createDataFrame(rows, "indicator string, unit string, year int, value double"), "P", "C", 2002).collect()
    assert sorted((r.indicator, r.year) for r in got if r.boundary) == [("i", 2000), ("i", 2001), ("k", 2001)]
    assert sorted((r.unit, r.year) for r in got if r.status == "gone") == [("C", 2000), ("C", 2001)]


def stops(df, *parts):
    with pytest.raises(PySparkException) as e:
        df.write.format("noop").mode("overwrite").save()
    assert all(p in str(e.value) for p in parts), str(e.value)[:300]


def test_checks_stop(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, -1.0), ("c", 2, None)], "k string, e int, v double")
    good = df.where("v > 0")
    stops(guard.every(df, F.col("v") >= 0, ["k"], "negative"), "negative: 2 rows, b; c")
    assert guard.every(good, F.col("v") >= 0, ["k"], "negative").count() == 1
    stops(guard.unique(df.union(df.limit(1)), ["k"]), "a key has several rows: 1 rows")
    assert guard.unique(df, ["k"]).count() == 3 and guard.unique(df.limit(0), ["k"]).count() == 0
    stops(guard.some(df.limit(0), "nothing was read"), "nothing was read: 0 rows of at least 1")
    stops(guard.some(df, "too few", 4), "too few: 3 rows of at least 4")
    assert guard.some(df, "too few", 3).count() == 3 and guard.some(df, "any", 0).count() == 3
    kinds = spark.createDataFrame([("x",), ("y",)], "kind string")
    stops(guard.every_kind(df, kinds, ["x", "z", "q"]), "a kind of check matched nothing: q, z")
    assert guard.every_kind(df, kinds, ["x", "y"]).count() == 3


def test_many_offenders_are_counted(spark):
    stops(guard.every(spark.range(1000).withColumn("v", F.lit(-1)), F.col("v") > 0, ["id"], "bad"), "bad: 1000 rows, 0; 1; 10; 100; 101")


def test_editions(spark):
    rows = [("a", 1, 2.0), ("a", 2, 2.0), ("b", 2, 3.0)]
    df = spark.createDataFrame(rows, "k string, e int, v double")
    assert sorted(tuple(r) for r in guard.newest_that_agree(df, ["k"], "v", "e").collect()) == [("a", 2.0, 2), ("b", 3.0, 1)]
    stops(guard.newest_that_agree(df.union(spark.createDataFrame([("b", 1, 4.0)], df.schema)), ["k"], "v", "e"), "editions differ: 1 rows, b")
    stops(guard.newest_that_agree(df.where("e = 2"), ["k"], "v", "e"), "editions overlap on 0 cells of at least 1")
    other = spark.createDataFrame([("a", 2.04), ("b", 3.0)], "k string, v double")
    assert guard.cross_checked(df, other, ["k"], "v", 1, 3).count() == 3
    stops(guard.cross_checked(df, other, ["k"], "v", 2, 1), "tables differ: 2 rows, a")
    stops(guard.cross_checked(df, other, ["k"], "v", 1, 4), "tables share 3 keys of at least 4")
