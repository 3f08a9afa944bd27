"""The driver contract: names, the flagship query, SQL agreement on small tables, and life without the optional subpackage."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from regioscope import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    key = lambda r: tuple((x is None, "" if x is None else x) for x in r)
    order = [want.columns.index(c) for c in columns]
    b = sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=key)
    for partitions in (1, 3, 8):  # the order of sums does not show
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = catalogue.QUERIES[name](spark, SF)
        assert sorted(got.columns) == columns
        assert sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=key) == b, partitions


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("module", ["checks", "discontinuity", "estimates", "modules", "pages", "panels", "regional", "series", "survey", "views"])
def test_modules_import_alone(module):
    subprocess.run([sys.executable, "-c", f"import regioscope.plans.{module}"], cwd=ROOT, check=True)


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
