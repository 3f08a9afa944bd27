"""Reconciliation: cells printed several times, parts against totals, refusals published as rows.

Every validator returns what it keeps and what it refuses, with a reason, from one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import measures as M
from ..sources.tables import CELLS, regional_cells, table

#: Ratio up to which a difference is a revision, tolerances of parts against totals.
REVISION = 1.10
TOLERANCE, FLOOR = 0.02, 1.0
MONTH_TOLERANCE = 0.005


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell is (product, year); every printing has an edition number and a value."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")  # noqa: E741
    cell = Window.partitionBy("l_partkey", "year").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return l.withColumn("year", F.year("l_shipdate")).withColumn("edition", F.row_number().over(cell)).select(F.col("l_partkey").alias("product"), "year", "edition", (50 + 100 * F.col("l_discount")).alias("value"))


EDITIONS = """ed AS (SELECT l_partkey AS product, CAST(year(l_shipdate) AS INT) AS year, 50 + 100 * l_discount AS value,
 row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_discount) AS edition FROM lineitem),
st AS (SELECT product, year, CAST(count(*) AS BIGINT) AS n_editions, min(value) AS lo, max(value) AS hi, arg_max(value, edition) AS value FROM ed GROUP BY ALL),
ag AS (SELECT *, CASE WHEN n_editions = 1 THEN 'single source' WHEN lo = hi THEN 'confirmed' WHEN hi <= lo * 1.10 THEN 'revised' ELSE 'conflict' END AS agreement FROM st)"""


def reconcile(df: DataFrame, keys: list[str], value: str, edition: str) -> DataFrame:
    """One row for each cell: newest value, number of editions, agreement; one aggregate with partial combine."""
    n, lo, hi = F.count("*"), F.min(value), F.max(value)
    agreement = F.when(n == 1, "single source").when(lo == hi, "confirmed").when(hi <= lo * REVISION, "revised").otherwise("conflict")
    return df.groupBy(*keys).agg(F.max_by(value, edition).alias("value"), n.cast("bigint").alias("n_editions"), agreement.alias("agreement"))


@query("reconcile_editions", f"WITH {EDITIONS} SELECT product, year, round_even(value, 4) AS value, n_editions, agreement FROM ag WHERE agreement <> 'conflict'")
def reconcile_editions(spark, sf_dir) -> DataFrame:
    r = reconcile(editions(spark, sf_dir), ["product", "year"], "value", "edition").where("agreement <> 'conflict'")
    return r.withColumn("value", F.bround("value", 4))


@query("reconcile_conflicts", f"WITH {EDITIONS} SELECT ed.product, ed.year, round_even(ed.value, 4) AS value, CAST(ed.edition AS INT) AS edition, 'editions differ by more than a revision' AS reason FROM ed JOIN ag USING (product, year) WHERE agreement = 'conflict'")
def reconcile_conflicts(spark, sf_dir) -> DataFrame:
    """Every printing of a conflicting cell, published with the reason; window aggregates, no join."""
    e = editions(spark, sf_dir)
    cell = Window.partitionBy("product", "year")
    e = e.withColumn("bad", (F.count("*").over(cell) > 1) & (F.max("value").over(cell) > F.min("value").over(cell) * REVISION))
    return e.where("bad").select("product", "year", F.bround("value", 4).alias("value"), "edition", F.lit("editions differ by more than a revision").alias("reason"))


@query("agreement_histogram", f"WITH {EDITIONS} SELECT agreement, CAST(count(*) AS BIGINT) AS cells, CAST(sum(n_editions) AS BIGINT) AS printings FROM ag GROUP BY ALL")
def agreement_histogram(spark, sf_dir) -> DataFrame:
    r = reconcile(editions(spark, sf_dir), ["product", "year"], "value", "edition")
    return r.groupBy("agreement").agg(F.count("*").cast("bigint").alias("cells"), F.sum("n_editions").cast("bigint").alias("printings"))


@query("latest_edition", f"WITH {EDITIONS} SELECT product, year, round_even(value, 4) AS value, CAST(edition AS INT) AS edition FROM ed QUALIFY row_number() OVER (PARTITION BY product, year ORDER BY edition DESC) = 1")
def latest_edition(spark, sf_dir) -> DataFrame:
    """Deduplication to the newest printing."""
    return editions(spark, sf_dir).groupBy("product", "year").agg(F.bround(F.max_by("value", "edition"), 4).alias("value"), F.max("edition").alias("edition"))


def _off(gap, printed):
    return F.abs(gap) <= F.greatest(F.abs(printed) * TOLERANCE, F.lit(FLOOR))


_PRINTED = """pr AS (SELECT segment, year, region, sum(value * CASE WHEN (year + length(segment) + length(region)) % 4 = 0 THEN 1.05 ELSE 1 END) AS printed FROM cells GROUP BY ALL)"""


def printed_regions(cells: DataFrame) -> DataFrame:
    """Region totals as printed, wrong by five percent in a fixed set of rows."""
    wrong = (F.col("year") + F.length("segment") + F.length("region")) % 4 == 0
    return cells.groupBy("segment", "year", "region").agg(F.sum("value").alias("printed")).withColumn("printed", F.col("printed") * F.when(wrong, 1.05).otherwise(1.0))


@query("subtotal_check", f"""WITH {CELLS}, {_PRINTED}, p AS (SELECT segment, year, region, CAST(count(*) AS BIGINT) AS parts, sum(value) AS total, avg(value) AS mean FROM cells GROUP BY ALL)
SELECT segment, year, region, parts, round_even(total, 2) AS total, round_even(mean, 5) AS mean, round_even(printed, 4) AS printed, round_even(total / printed - 1, 6) + 0.0 AS gap, segment <> 'MACHINERY' AS additive,
 CASE WHEN segment <> 'MACHINERY' THEN abs(total - printed) <= greatest(abs(printed) * 0.02, 1.0) END AS agrees FROM p JOIN pr USING (segment, year, region)""")
def subtotal_check(spark, sf_dir) -> DataFrame:
    """Sum and mean of parts against the printed subtotal; whether they agree is null where parts do not add up by nature."""
    cells = regional_cells(spark, sf_dir)
    keys = ["segment", "year", "region"]
    parts = cells.groupBy(*keys).agg(F.count("*").cast("bigint").alias("parts"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    j = parts.join(printed_regions(cells), keys)
    additive = F.col("segment") != "MACHINERY"
    return j.select(
        *keys, "parts", F.bround("total", 2).alias("total"), F.bround("mean", 5).alias("mean"), F.bround("printed", 4).alias("printed"), M.publish(F.try_divide("total", "printed") - 1).alias("gap"),
        additive.alias("additive"), F.when(additive, _off(F.col("total") - F.col("printed"), F.col("printed"))).alias("agrees"),
    )


@query("national_total_check", f"""WITH {CELLS}, {_PRINTED}, n AS (SELECT segment, year, sum(printed) AS printed FROM pr GROUP BY ALL), s AS (SELECT segment, year, CAST(count(*) AS BIGINT) AS units, sum(value) AS total FROM cells GROUP BY ALL)
SELECT segment, year, units, round_even(total, 2) AS total, round_even(printed, 4) AS printed, abs(total - printed) <= greatest(abs(printed) * 0.02, 5.0) AS agrees FROM s JOIN n USING (segment, year) WHERE units = 25""")
def national_total_check(spark, sf_dir) -> DataFrame:
    """All units summed against the national figure, complete groups only."""
    cells = regional_cells(spark, sf_dir)
    printed = printed_regions(cells).groupBy("segment", "year").agg(F.sum("printed").alias("printed"))
    s = cells.groupBy("segment", "year").agg(F.count("*").cast("bigint").alias("units"), F.sum("value").alias("total")).where("units = 25")
    ok = F.abs(F.col("total") - F.col("printed")) <= F.greatest(F.abs("printed") * TOLERANCE, F.lit(5.0))
    return s.join(printed, ["segment", "year"]).select("segment", "year", "units", F.bround("total", 2).alias("total"), F.bround("printed", 4).alias("printed"), ok.alias("agrees"))


_PARTS = """b AS (SELECT l_partkey AS product, CAST(year(l_shipdate) AS INT) AS year, sum(l_quantity) AS both_, sum(l_quantity) FILTER (l_linestatus = 'F') AS f, sum(l_quantity) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY ALL),
x AS (SELECT product, year, both_ + CASE WHEN (product + year) % 7 = 0 THEN 1 ELSE 0 END AS both_, f, o FROM b), y AS (SELECT *, f IS NOT NULL AND o IS NOT NULL AND abs(f + o - both_) > 0.15 AS refused FROM x)"""


def _parts(spark, sf_dir) -> DataFrame:
    """One frame with the verdict on each group; kept and refused rows are its two sides."""
    q = F.col("l_quantity")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product"), F.year("l_shipdate").alias("year")).agg(
        F.sum(q).alias("both"), F.sum(F.when(F.col("l_linestatus") == "F", q)).alias("f"), F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("o"))
    b = b.withColumn("both", F.col("both") + F.when((F.col("product") + F.col("year")) % 7 == 0, 1.0).otherwise(0.0))
    return b.withColumn("refused", F.coalesce(F.abs(F.col("f") + F.col("o") - F.col("both")) > 0.15, F.lit(False)))


@query("parts_consistency_kept", f"WITH {_PARTS}, k AS (UNPIVOT (SELECT product, year, both_ AS \"both\", f, o FROM y WHERE NOT refused) ON \"both\", f, o INTO NAME part VALUE value) SELECT * FROM k")
def parts_consistency_kept(spark, sf_dir) -> DataFrame:
    """Two parts and their whole in long form, without the groups that do not add up."""
    return _parts(spark, sf_dir).where(~F.col("refused")).unpivot(["product", "year"], ["both", "f", "o"], "part", "value").where("value is not null")


@query("parts_consistency_refused", f"WITH {_PARTS} SELECT product, year, f + o AS parts, both_ AS printed, 'parts do not sum to the whole' AS reason FROM y WHERE refused")
def parts_consistency_refused(spark, sf_dir) -> DataFrame:
    return _parts(spark, sf_dir).where("refused").select("product", "year", (F.col("f") + F.col("o")).alias("parts"), F.col("both").alias("printed"), F.lit("parts do not sum to the whole").alias("reason"))


@query("boundary_break", f"""WITH {CELLS}, c AS (SELECT segment, year, nation, CASE WHEN nation = 'NATION_3' AND year < 1997 + length(segment) % 3 THEN 0 ELSE value END AS value FROM cells),
f AS (SELECT segment, least(coalesce(min(year) FILTER (nation = 'NATION_3' AND value > 0), 2002), 2002) AS first_year FROM c GROUP BY ALL)
SELECT segment, year, nation, round_even(value, 2) AS value, CASE WHEN nation = 'NATION_2' THEN CASE WHEN year >= first_year THEN 'after split' ELSE 'before split' END END AS boundary FROM c JOIN f USING (segment) WHERE NOT (nation = 'NATION_3' AND year < first_year)""")
def boundary_break(spark, sf_dir) -> DataFrame:
    """A unit that was split: the parent is marked from the child's first positive year, earlier child rows go."""
    early = (F.col("nation") == "NATION_3") & (F.col("year") < 1997 + F.length("segment") % 3)
    c = regional_cells(spark, sf_dir).select("segment", "year", "nation", F.when(early, 0.0).otherwise(F.col("value")).alias("value"))
    first = c.where("nation = 'NATION_3' and value > 0").groupBy("segment").agg(F.least(F.min("year"), F.lit(2002)).alias("first_year"))
    c = c.join(F.broadcast(first), "segment", "left").withColumn("first_year", F.coalesce("first_year", F.lit(2002)))
    mark = F.when(F.col("nation") == "NATION_2", F.when(F.col("year") >= F.col("first_year"), "after split").otherwise("before split"))
    return c.where(~((F.col("nation") == "NATION_3") & (F.col("year") < F.col("first_year")))).select("segment", "year", "nation", F.bround("value", 2).alias("value"), mark.alias("boundary"))


_MONTHS = """m AS (SELECT p_type AS series, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
a AS (SELECT series, year, count(*) AS months, sum(value) AS total, sum(value * CASE WHEN (year + length(series)) % 5 = 0 THEN 1.02 ELSE 1 END) AS printed FROM m GROUP BY ALL)"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.sum("l_extendedprice").alias("v"))  # noqa: E741
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("series"))
    return l.join(p, l.l_partkey == p.p_partkey).groupBy("series", "year", "month").agg(F.sum("v").alias("value"))


def annual_totals(m: DataFrame) -> DataFrame:
    wrong = (F.col("year") + F.length("series")) % 5 == 0
    return m.groupBy("series", "year").agg(F.count("*").alias("months"), F.sum("value").alias("total")).withColumn("printed", F.col("total") * F.when(wrong, 1.02).otherwise(1.0))


@query("monthly_total_check", f"WITH {_MONTHS} SELECT series, year, CAST(months AS BIGINT) AS months, round_even(total, 2) AS total, round_even(printed, 4) AS printed, abs(total - printed) <= 0.005 * abs(printed) AS agrees FROM a WHERE months = 12")
def monthly_total_check(spark, sf_dir) -> DataFrame:
    """Twelve months against the printed year, half a percent."""
    a = annual_totals(months(spark, sf_dir)).where("months = 12")
    ok = F.abs(F.col("total") - F.col("printed")) <= MONTH_TOLERANCE * F.abs("printed")
    return a.select("series", "year", F.col("months").cast("bigint").alias("months"), F.bround("total", 2).alias("total"), F.bround("printed", 4).alias("printed"), ok.alias("agrees"))


@query("monthly_refusal_scope", f"""WITH {_MONTHS}, bad AS (SELECT series, year FROM a WHERE months = 12 AND abs(total - printed) > 0.005 * abs(printed)), odd AS (SELECT series, year, month FROM m WHERE (year * 12 + month + length(series)) % 17 = 0)
SELECT m.series, m.year, m.month, round_even(m.value, 2) AS value, CASE WHEN bad.series IS NOT NULL THEN 'year refused' WHEN odd.series IS NOT NULL THEN 'month refused' ELSE 'kept' END AS status FROM m LEFT JOIN bad USING (series, year) LEFT JOIN odd USING (series, year, month)""")
def monthly_refusal_scope(spark, sf_dir) -> DataFrame:
    """A failed year takes its twelve months, a failed month only itself; both scopes stay apart."""
    m = months(spark, sf_dir)
    bad = annual_totals(m).where("months = 12").where(F.abs(F.col("total") - F.col("printed")) > MONTH_TOLERANCE * F.abs("printed")).select("series", "year", F.lit(True).alias("bad"))
    odd = (F.col("year") * 12 + F.col("month") + F.length("series")) % 17 == 0
    status = F.when(F.col("bad"), "year refused").when(odd, "month refused").otherwise("kept")
    return m.join(bad, ["series", "year"], "left").select("series", "year", "month", F.bround("value", 2).alias("value"), status.alias("status"))


@query("coverage_report", f"""WITH {EDITIONS}, tried AS (SELECT product, CAST(count(*) AS BIGINT) AS printings, CAST(count(DISTINCT year) AS BIGINT) AS cells FROM ed GROUP BY ALL), k AS (SELECT product, CAST(count(*) FILTER (agreement <> 'conflict') AS BIGINT) AS kept, CAST(count(*) FILTER (agreement = 'conflict') AS BIGINT) AS conflicts FROM ag GROUP BY ALL)
SELECT p_partkey AS product, coalesce(printings, 0) AS printings, coalesce(cells, 0) AS cells, coalesce(kept, 0) AS kept, coalesce(conflicts, 0) AS conflicts, printings IS NULL AS missing FROM part LEFT JOIN tried ON product = p_partkey LEFT JOIN k USING (product)""")
def coverage_report(spark, sf_dir) -> DataFrame:
    """What was tried, kept, conflicted or missing, by product: one aggregate of the cells, one left join."""
    r = reconcile(editions(spark, sf_dir), ["product", "year"], "value", "edition")
    conflict = F.col("agreement") == "conflict"
    by = r.groupBy("product").agg(F.sum("n_editions").alias("printings"), F.count("*").alias("cells"), F.count_if(~conflict).alias("kept"), F.count_if(conflict).alias("conflicts"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"))
    return p.join(by, "product", "left").withColumn("missing", F.col("printings").isNull()).fillna(0, ["printings", "cells", "kept", "conflicts"])


@query("expected_minus_present", """SELECT n_name AS nation, CAST(y AS INT) AS year FROM nation, generate_series(1995, 2002) AS g(y) WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND year(o_orderdate) = y)""")
def expected_minus_present(spark, sf_dir) -> DataFrame:
    """Cells that should exist and do not (anti join against the expected grid of units and years)."""
    grid = table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), F.explode(F.sequence(F.lit(1995), F.lit(2002))).alias("year"))
    return grid.join(regional_cells(spark, sf_dir).select("nation", "year").distinct(), ["nation", "year"], "left_anti")


@query("invariants", f"""WITH {CELLS} SELECT 'key is unique' AS "check", count(*) = count(DISTINCT segment || '|' || year || '|' || nation) AS ok FROM cells UNION ALL SELECT 'no negative value', bool_and(value >= 0) FROM cells
UNION ALL SELECT 'at least 23 units by indicator', min(u) >= 23 FROM (SELECT segment, count(DISTINCT nation) AS u FROM cells GROUP BY ALL)""")
def invariants(spark, sf_dir) -> DataFrame:
    """Panel invariants as rows, from one pass over the cells; a sink evaluates them before it writes."""
    by = regional_cells(spark, sf_dir).groupBy("segment", "nation", "year").agg(F.count("*").alias("n"), F.min("value").alias("low"))
    by = by.groupBy("segment", "nation").agg(F.max("n").alias("n"), F.min("low").alias("low")).groupBy("segment").agg(F.max("n").alias("n"), F.min("low").alias("low"), F.count("*").alias("units"))
    ok = {"key is unique": F.max("n") <= 1, "no negative value": F.min("low") >= 0, "at least 23 units by indicator": F.min("units") >= 23}
    rows = F.array(*[F.struct(F.lit(k).alias("check"), c.alias("ok")) for k, c in ok.items()])
    return by.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.check", "r.ok")
