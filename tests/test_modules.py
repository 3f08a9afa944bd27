"""Joins of modules with colliding columns, label indexes and leaked numbers."""

import pytest
from pyspark.errors import PySparkException

from regioscope.operators import microdata as MD


def frame(spark, schema, *rows):
    return spark.createDataFrame(rows, schema)


def test_joined(spark):
    left = frame(spark, "h int, p int, age int, sex int", (1, 1, 30, 0), (1, 2, None, 1), (2, 1, 50, None), (None, 1, 9, 0))
    right = frame(spark, "h int, p int, age int, sex int, level string", (1, 1, 31, 0, "x"), (1, 2, 40, 1, "y"), (2, 1, 50, 1, None), (3, 1, 1, 1, "z"), (None, 1, 1, 1, "n"))
    got = MD.joined(left, right, ["h", "p"], rename={"age": "exact"})
    assert got.columns == ["h", "p", "age", "sex", "exact", "level"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 1, 30, 0, 31, "x"), (1, 2, None, 1, 40, "y"), (2, 1, 50, 1, 50, None), (None, 1, 9, 0, None, None)]))
    assert MD.joined(left, right, ["h", "p"], drop=("age",)).columns == ["h", "p", "age", "sex", "level"]
    for bad, words in ((right, "the modules differ on age: 1 | 1"), (right.union(right.limit(1)), "twice")):
        with pytest.raises(PySparkException) as e:
            MD.joined(left, bad, ["h", "p"]).collect()
        assert words in str(e.value)
    filled = MD.joined(left, right.drop("age"), ["h", "p"]).where("h = 2").first()
    assert (filled.sex, filled.level) == (1, None) and MD.joined(left, right.limit(0), ["h", "p"]).count() == 4


def test_label_index(spark):
    books = frame(spark, "column string, origin int, code int, label string", ("a", 2, 1, "un"), ("a", 2, 2, "deux"), ("a", 3, 2, "zwei"), ("a", 3, 3, "drei"), ("b", 3, 1, "eins"), ("c", 1, 1, "x"))
    other = frame(spark, "column string, code int, label string", ("a", 1, "one"), ("a", 9, "nine"), ("c", 1, "x"))
    got = {(r.column, r.code): (r.origin, r.label, r.other_label, r.conflict) for r in MD.label_index(books, other, frame(spark, "column string", ("a",), ("b",))).collect()}
    assert got == {("a", 1): (2, "un", "one", False), ("a", 2): (2, "deux", MD.UNMAPPED, True), ("a", 9): (2, "", "nine", False), ("b", 1): (3, "eins", MD.UNMAPPED, False)}


def test_rejoined(spark):
    rows = [("t", "Ariana"), ("t", "7        Ariana"), ("t", "1  2  3  4  Ariana"), ("t", "1  2  3  4  5  Ariana"), ("t", "7 Ariana"), ("t", "20 à 24 ans"), ("t", "3   20 à 24 ans"), ("u", "7   Ariana"), ("u", None), ("t", "")]
    got = [(r.title, r.label, r.rejoined, r.repair) for r in MD.rejoined(spark.createDataFrame(rows, "title string, label string"), ["title"], "label").collect()]
    fixed = {("t", "7        Ariana"): "Ariana", ("t", "1  2  3  4  Ariana"): "Ariana", ("t", "3   20 à 24 ans"): "20 à 24 ans"}
    refused = {("t", "1  2  3  4  5  Ariana"), ("u", "7   Ariana")}
    assert len(got) == len(rows)
    for t, x, y, how in got:
        assert (y, how) == ((fixed[t, x], "repaired") if (t, x) in fixed else (x, "refused") if (t, x) in refused else (x, "untouched"))
