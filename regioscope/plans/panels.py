"""The panel of units, years and indicators from printed cells: resolved labels, pooled printings, totals, both sexes, and checks that stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..functions import text as T
from ..operators import guard
from ..operators import panel as P
from ..sources.tables import CELLS, geography, population, regional_cells, table

#: The unit that was split, what came of it, the last year in which a series may have taken the split over.
PARENT, CHILD, SPLIT_LAST = "NATION B", "NATION C", 1996
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CAPTIONS = {"Masculin": "population_male", "Féminin": "population_female", "Masculin et Féminin": "population_all"}
DISPUTED = "two printings of the same cell disagree"
TOTAL = "the units do not sum to the printed total"
GONE = f"{CHILD} did not exist yet; the printed 0 is not an observation"
SEX = "men plus women do not make the figure printed for both sexes"


#: Labels are told apart by letters alone, so a unit's number is spelt with letters.
_DIGITS, _SPELT = "0123456789_", "ABCDEFGHIJ "
_NAME = f"translate(n_name, '{_DIGITS}', '{_SPELT}')"


def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nationkey and the name of each unit."""
    return geography(spark, sf_dir).select("nationkey", F.translate("nation", _DIGITS, _SPELT).alias("name"))


def printed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as books print them: labels with leaked numbers, accents and other case, three forms of a period, second printings, other columns and titles, totals."""
    v = regional_cells(spark, sf_dir).groupBy("segment", "year", "nationkey").agg(F.bround(F.sum("value"), 2).alias("value"))
    v = v.join(F.broadcast(unit_names(spark, sf_dir)), "nationkey").withColumnRenamed("name", "nation")
    v = v.withColumn("value", F.when((F.col("nation") == CHILD) & (F.col("year") < 1995), 0.0).otherwise(F.col("value")))
    k, year = F.col("nationkey"), F.col("year")
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    name = F.when(k % 3 == 0, F.col("nation")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("    "), F.col("nation"))).otherwise(F.replace(F.lower("nation"), F.lit("a"), F.lit("à")))
    period = F.when(year % 3 == 0, year.cast("string")).when(year % 3 == 1, F.concat(year.cast("string"), F.lit("/"), two(year + 1))).otherwise(F.concat(two(year + 1), F.lit("-"), two(year)))
    title = F.concat(F.lit("Valeur "), F.lower("segment"))
    agreement = F.when((k + year) % 7 == 0, "revised").otherwise("single source")
    cell = lambda title, label, column, value, n, agreement, kind: v.select(title.alias("title"), label.alias("row_label"), column.alias("column_label"), "year", value.alias("value"), n.cast("bigint").alias("n_editions"), agreement.alias("agreement"), F.lit(kind).alias("row_kind"), "nationkey", "segment")
    one, single = F.lit(1), F.lit("single source")
    first = cell(title, name, period, F.col("value"), 1 + k % 2, agreement, "data")
    wrong = (F.col("segment") == "BUILDING") & ((k + year) % 25 == 0)
    again = cell(title, F.concat(F.lit("12   "), F.col("nation")), year.cast("string"), F.col("value") + F.when(wrong, 1).otherwise(0), one, single, "data").where("nationkey % 4 = 1")
    bands = cell(title, F.col("nation"), F.lit("24-20"), F.lit(1.0), one, single, "data").where("nationkey = 3")
    other = cell(F.lit("Autre tableau"), F.col("nation"), year.cast("string"), F.col("value"), one, single, "data").where("nationkey = 1")
    out = first.unionByName(again).unionByName(bands).unionByName(other).drop("nationkey", "segment")
    off = F.when((year + F.length("segment")) % 4 == 0, 1.05).otherwise(1.0)
    totals = v.groupBy("segment", "year").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("s")).select(
        title.alias("title"), F.lit("Total").alias("row_label"), year.cast("string").alias("column_label"), "year", F.bround(F.col("s") * off, 2).alias("value"), F.lit(1).cast("bigint").alias("n_editions"), single.alias("agreement"), F.lit("aggregate").alias("row_kind"),
    )
    return out.unionByName(totals)


_SERIES = f"""{CELLS}, un AS (SELECT n_nationkey AS nationkey, {_NAME} AS nation FROM nation),
v AS (SELECT segment, year, nation, nationkey, CASE WHEN nation = '{CHILD}' AND year < 1995 THEN 0 ELSE round_even(s, 2) END AS value FROM (SELECT segment, year, nationkey, sum(value) AS s FROM cells GROUP BY ALL) JOIN un USING (nationkey)),
pr AS (SELECT lower(segment) AS indicator, nation AS unit, year, value, 1 + nationkey % 2 AS n_editions, (nationkey + year) % 7 = 0 AS revised FROM v
 UNION ALL SELECT lower(segment), nation, year, value + CASE WHEN segment = 'BUILDING' AND (nationkey + year) % 25 = 0 THEN 1 ELSE 0 END, 1, false FROM v WHERE nationkey % 4 = 1),
po AS (SELECT indicator, unit, year, min(value) AS value, count(DISTINCT value) AS d, CAST(sum(n_editions) AS BIGINT) AS n_editions, bool_or(revised) AS revised FROM pr GROUP BY ALL),
tt AS (SELECT lower(segment) AS indicator, year, round_even(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) * CASE WHEN (year + length(segment)) % 4 = 0 THEN 1.05 ELSE 1 END, 2) AS printed FROM v GROUP BY segment, year),
ck AS (SELECT po.indicator, po.year, abs(sum(value) - any_value(printed)) <= greatest({P.TOLERANCE} * abs(any_value(printed)), {P.FLOOR}) AS agrees FROM po JOIN tt ON po.indicator = tt.indicator AND po.year = tt.year WHERE d = 1 GROUP BY po.indicator, po.year),
fy AS (SELECT indicator, min(CASE WHEN year > {SPLIT_LAST} THEN {SPLIT_LAST} ELSE year END) AS starts FROM po WHERE d = 1 AND unit = '{CHILD}' AND value > 0 GROUP BY indicator),
cv AS (SELECT DISTINCT indicator, year, '{DISPUTED}' AS reason FROM po WHERE d > 1 UNION ALL SELECT indicator, year, '{TOTAL}' FROM ck WHERE NOT agrees),
pa AS (SELECT po.*, coalesce(year < starts, false) AS early FROM po LEFT JOIN fy USING (indicator) WHERE d = 1)"""


def panel_with_refusals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(panel, refusals). A refused year takes all its units with it, a refused cell only itself; the two scopes stay apart."""
    series = printed_cells(spark, sf_dir)
    known = spark.createDataFrame([(f"Valeur {s.lower()}", s.lower()) for s in SEGMENTS], "title string, indicator string")
    series = series.join(F.broadcast(known), "title")
    names = unit_names(spark, sf_dir).select("name")
    rows = P.resolve(series.where("row_kind = 'data'"), names, "row_label", "unit").where(F.col("unit").isNotNull() & P.is_period(F.col("column_label"), F.col("year")))
    cells = P.pool(rows, ["indicator", "unit", "year"])
    kept = cells.where("status = 'kept'")
    printed = series.where("row_kind = 'aggregate'").select("indicator", "year", F.col("value").alias("printed"))
    failed = P.against_totals(kept, printed, ["indicator", "year"]).where(~F.col("agrees"))
    years = cells.where("status = 'disputed'").select("indicator", "year").distinct().withColumn("reason", F.lit(DISPUTED)).union(failed.select("indicator", "year", F.lit(TOTAL)))
    split = P.boundary(kept, PARENT, CHILD, SPLIT_LAST)
    gone = split.where("status = 'gone'").select("indicator", "year", "unit", F.lit(GONE).alias("reason"))
    panel = split.where("status = 'kept'").join(F.broadcast(years.select("indicator", "year").distinct()), ["indicator", "year"], "left_anti")
    people = population(spark, sf_dir).join(F.broadcast(unit_names(spark, sf_dir)), "nationkey").select(F.col("name").alias("unit"), "population")
    panel = panel.join(F.broadcast(people), "unit", "left").select("indicator", "unit", "year", "value", "n_editions", "agreement", "boundary", "population")
    return panel, years.select("indicator", "year", F.lit("").alias("unit"), "reason").unionByName(gone)


@query("unit_panel", f"""WITH {_SERIES} SELECT indicator, unit, year, value, n_editions, CASE WHEN revised THEN 'revised' WHEN n_editions > 1 THEN 'confirmed' ELSE 'single source' END AS agreement,
 CASE WHEN early AND unit = '{PARENT}' THEN 'includes {CHILD}, which was still part of {PARENT}' ELSE '' END AS boundary, population FROM pa LEFT JOIN (SELECT nation AS unit, population FROM pop JOIN un USING (nationkey)) USING (unit)
 WHERE NOT (early AND unit = '{CHILD}') AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.indicator = pa.indicator AND cv.year = pa.year)""")
def unit_panel(spark, sf_dir) -> DataFrame:
    """What is left after labels, periods, printings, totals and the split have been judged."""
    return panel_with_refusals(spark, sf_dir)[0]


@query("unit_panel_refusals", f"WITH {_SERIES} SELECT indicator, year, '' AS unit, reason FROM cv UNION ALL SELECT indicator, year, unit, '{GONE}' FROM pa WHERE early AND unit = '{CHILD}'")
def unit_panel_refusals(spark, sf_dir) -> DataFrame:
    """Everything that was refused, with the reason; an empty unit stands for a whole year."""
    return panel_with_refusals(spark, sf_dir)[1]


@query("longest_label", """WITH l AS (SELECT p_partkey AS product, p_type || ' ' || p_name AS label, regexp_replace(lower(p_type || ' ' || p_name), '[^a-z]', '', 'g') AS f FROM part),
a AS (SELECT DISTINCT p_type AS name, regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS f FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1), lower(split_part(p_type, ' ', 1)) FROM part)
SELECT product, arg_max(a.name, length(a.f)) AS name FROM l JOIN a ON starts_with(l.f, a.f) GROUP BY product""")
def longest_label(spark, sf_dir) -> DataFrame:
    """Labels that go on after a name: the longest of the names that a label begins with."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_type").distinct().select(F.explode(F.array("p_type", F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("name")).distinct()
    labels = part.select(F.col("p_partkey").alias("product"), F.concat_ws(" ", "p_type", "p_name").alias("label"))
    return P.resolve(labels, names, "label", "name_", longest=True).select("product", F.col("name_").alias("name"))


_AGES = ("04-00", "09-05", "14-10", "19-15", "24-20", "80 et plus")
_BAND = "least(greatest(CAST(floor((c_acctbal + 1000) / 2000) AS INT), 0), 5)"


def printed_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of one table, told apart by their captions alone: men, women, and both (off by one for some units)."""
    c = table(spark, sf_dir, "customer")
    band = F.element_at(F.array(*map(F.lit, _AGES)), F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 2000).cast("int"), F.lit(0)), F.lit(5)) + 1)
    n = c.groupBy("c_nationkey", (1995 + F.col("c_custkey") % 4).cast("int").alias("year"), band.alias("column_label")).agg(F.count_if(F.col("c_custkey") % 2 == 0).alias("m"), F.count_if(F.col("c_custkey") % 2 == 1).alias("f"))
    n = n.join(F.broadcast(unit_names(spark, sf_dir)), F.col("c_nationkey") == F.col("nationkey"))
    both = F.col("m") + F.col("f") + F.when(F.col("nationkey") % 6 == 0, 1).otherwise(0)
    values = F.array(*[F.struct(F.lit(caption).alias("caption"), x.cast("double").alias("value")) for caption, x in zip(CAPTIONS, (F.col("m"), F.col("f"), both), strict=True)])
    return n.select(F.col("name").alias("row_label"), "year", "column_label", F.inline(values))


def _ages(spark, sf_dir) -> DataFrame:
    indicator = F.element_at(F.create_map(*[F.lit(x) for pair in CAPTIONS.items() for x in pair]), F.col("caption"))
    rows = printed_ages(spark, sf_dir).where(F.col("caption").isin(*CAPTIONS)).withColumns({"indicator": indicator, "breakdown": T.age_band(F.col("column_label"))})
    rows = P.resolve(rows, unit_names(spark, sf_dir).select("name"), "row_label", "unit").where("unit is not null and breakdown is not null")
    return P.sexes(rows, ["unit", "year", "breakdown"], *CAPTIONS.values())


_AGE_SQL = f"""WITH n AS (SELECT {_NAME} AS unit, n_nationkey AS k, CAST(1995 + c_custkey % 4 AS INT) AS year, {_BAND} AS b, count(*) FILTER (c_custkey % 2 = 0) AS m, count(*) FILTER (c_custkey % 2 = 1) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
a AS (SELECT *, ['00-04', '05-09', '10-14', '15-19', '20-24', '80+'][b + 1] AS breakdown FROM n)"""


@query("population_by_age_and_sex", f"{_AGE_SQL} SELECT unit, year, breakdown, i.indicator, CAST(CASE i.indicator WHEN 'population_male' THEN m WHEN 'population_female' THEN f ELSE m + f END AS DOUBLE) AS value FROM a, (VALUES ('population_male'), ('population_female'), ('population_all')) AS i(indicator) WHERE k % 6 <> 0")
def population_by_age_and_sex(spark, sf_dir) -> DataFrame:
    """Cells whose men and women make the figure for both; the caption says which page is which."""
    return _ages(spark, sf_dir).where("fits").select("unit", "year", "breakdown", "indicator", "value")


@query("population_refusals", f"{_AGE_SQL} SELECT unit, year, breakdown, CAST(1 AS DOUBLE) AS gap, '{SEX}' AS reason FROM a WHERE k % 6 = 0")
def population_refusals(spark, sf_dir) -> DataFrame:
    """Where they do not, one of the three is misread and all go; a refusal for each unit, year and band."""
    return _ages(spark, sf_dir).where(~F.col("fits")).select("unit", "year", "breakdown", "gap", F.lit(SEX).alias("reason")).distinct()


@query("panel_accessor", f"WITH {_SERIES} SELECT unit, year, value FROM pa WHERE indicator = 'machinery' AND NOT (early AND unit = '{CHILD}') AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.indicator = pa.indicator AND cv.year = pa.year)")
def panel_accessor(spark, sf_dir) -> DataFrame:
    """One indicator of the panel; stops where a unit and year stand twice, a value is negative, or a kind of refusal never applied."""
    panel, refused = panel_with_refusals(spark, sf_dir)
    one = guard.unique(panel.where("indicator = 'machinery'"), ["unit", "year"], "the panel has a cell twice")
    one = guard.every(one, F.col("value") >= 0, ["unit", "year"], "a value is negative")
    kinds = refused.where(F.col("reason") != DISPUTED).select(F.col("reason").alias("kind"))
    return guard.every_kind(one, kinds, [TOTAL]).select("unit", "year", "value")


@query("editions_that_agree", f"""WITH {_SERIES} SELECT indicator, unit, year, value, CAST(count(*) AS BIGINT) AS n_editions FROM (SELECT * FROM pr WHERE indicator <> 'building') GROUP BY ALL""")
def editions_that_agree(spark, sf_dir) -> DataFrame:
    """The newest printing of each cell; stops where printings differ or none overlap, and where the table and the panel differ at one decimal."""
    series = printed_cells(spark, sf_dir).where("row_kind = 'data' and title like 'Valeur %' and title <> 'Valeur building'")
    rows = P.resolve(series, unit_names(spark, sf_dir).select("name"), "row_label", "unit").where(F.col("unit").isNotNull() & P.is_period(F.col("column_label"), F.col("year")))
    rows = rows.select(F.substring_index("title", " ", -1).alias("indicator"), "unit", "year", "value", F.col("row_label").alias("edition"))
    newest = guard.newest_that_agree(rows, ["indicator", "unit", "year"], "value", "edition")
    panel, _ = panel_with_refusals(spark, sf_dir)
    return guard.cross_checked(newest, panel, ["indicator", "unit", "year"], "value", 1, 10)
