"""Regional inequality: shares, index families, dispersion, Theil splits, Lorenz curves, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import measures as M
from ..sources.tables import CELLS, geography, population, regional_cells

#: The cutoff year, the units of a complete group.
CUTOFF = 1998
UNITS = 25


def period(year: str):
    return F.when(F.col(year) >= CUTOFF, "post").otherwise("pre")


def complete(df: DataFrame, keys: list[str], units: int) -> DataFrame:
    """Rows of groups that have exactly the expected number of units."""
    return df.withColumn("_units", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_units") == units).drop("_units")


_GINI = "CASE WHEN count(*) >= 2 AND {mu} > 0 THEN {g} END"
_PAIRS = """(SELECT segment, year, round_even(sum(abs(a.value - b.value)) / (2 * count(*) * avg(a.value)), 6) AS gini FROM {t} a JOIN {t} b USING (segment, year) GROUP BY ALL)"""


@query("region_inequality_decomposition", f"""WITH {CELLS},
regions AS (SELECT segment, year, region, sum(value) AS value, count(*) AS n, avg(value) AS m FROM cells GROUP BY ALL),
g1 AS {_PAIRS.format(t="cells")}, g2 AS {_PAIRS.format(t="regions")},
tot AS (SELECT segment, year, sum(value) AS s, avg(value) AS mu, count(*) AS n FROM cells GROUP BY ALL),
t AS (SELECT segment, year, sum(c.value / s * ln(c.value / mu)) AS theil FROM cells c JOIN tot USING (segment, year) GROUP BY ALL),
b AS (SELECT segment, year, sum(r.value / s * ln(r.m / mu)) AS between_ FROM regions r JOIN tot USING (segment, year) GROUP BY ALL),
w AS (SELECT segment, year, sum(c.value / s * ln(c.value / r.m)) AS within_ FROM cells c JOIN regions r USING (segment, year, region) JOIN tot USING (segment, year) GROUP BY ALL)
SELECT segment, year, CAST(tot.n AS BIGINT) AS units, g1.gini AS gini_nation, g2.gini AS gini_region, round_even(theil, 6) AS theil, round_even(between_, 6) AS theil_between,
 round_even(within_, 6) AS theil_within, round_even(between_ / theil, 6) AS between_share, CASE WHEN year >= {CUTOFF} THEN 'post' ELSE 'pre' END AS period
FROM tot JOIN t USING (segment, year) JOIN b USING (segment, year) JOIN w USING (segment, year) JOIN g1 USING (segment, year) JOIN g2 USING (segment, year)""")  # fmt: skip
def region_inequality_decomposition(spark, sf_dir) -> DataFrame:
    """Gini at both geographies and Theil-T split by region, by indicator and year."""
    cells = regional_cells(spark, sf_dir)
    keys = ["segment", "year"]
    low = M.ranked(cells, keys, "value", None).groupBy(*keys).agg(M.publish(M.gini_of_ranked()).alias("gini_nation"))
    regions = cells.groupBy(*keys, "region").agg(F.sum("value").alias("value"))
    high = M.ranked(regions, keys, "value", None).groupBy(*keys).agg(M.publish(M.gini_of_ranked()).alias("gini_region"))
    split = M.theil_split(cells, keys, "region", "value")
    return low.join(high, keys).join(split.drop("identity_holds"), keys).select(*keys, "units", "gini_nation", "gini_region", "theil", "theil_between", "theil_within", "between_share", period("year").alias("period"))


@query("national_share", f"""WITH {CELLS} SELECT segment, year, nation, round_even(100 * value / sum(value) OVER (PARTITION BY segment, year), 6) AS share FROM cells""")
def national_share(spark, sf_dir) -> DataFrame:
    """Each unit's percentage of the group total."""
    w = Window.partitionBy("segment", "year")
    return regional_cells(spark, sf_dir).select("segment", "year", "nation", M.publish(F.try_divide(100 * F.col("value"), F.sum("value").over(w))).alias("share"))


@query("per_head_comparable", f"""WITH {CELLS}, t AS (SELECT * , sum(value) OVER (PARTITION BY segment, year) AS tv, sum(population) OVER (PARTITION BY segment, year) AS tp FROM cells JOIN pop USING (nationkey))
SELECT segment, year, nation, basis, round_even(CASE basis WHEN 'per_head' THEN value / population ELSE (value / population) / (tv / tp) END, 8) AS comparable FROM t, (VALUES ('per_head'), ('relative')) AS b(basis)""")
def per_head_comparable(spark, sf_dir) -> DataFrame:
    """Per-head values and their ratio to the group's own per-head value, in long form by basis."""
    t = regional_cells(spark, sf_dir).join(F.broadcast(population(spark, sf_dir)), "nationkey", "left")
    w = Window.partitionBy("segment", "year")
    head = F.try_divide(F.col("value"), F.col("population"))
    t = t.withColumns({"per_head": head, "relative": F.try_divide(head, F.try_divide(F.sum("value").over(w), F.sum("population").over(w)))})
    return t.unpivot(["segment", "year", "nation"], ["per_head", "relative"], "basis", "comparable").withColumn("comparable", F.bround("comparable", 8))


def _family_sql(weight: str) -> str:
    pct = lambda q: f"coalesce(min(y) FILTER (round_even(c, 12) >= {q / 100}), max(y))"
    return f"""WITH {CELLS}, b AS (SELECT segment, year, nation, value AS y, CAST({weight} AS DOUBLE) AS raw FROM cells JOIN pop USING (nationkey)),
s AS (SELECT *, raw / sum(raw) OVER (PARTITION BY segment, year) AS w FROM b),
r AS (SELECT *, sum(w) OVER (PARTITION BY segment, year ORDER BY y, raw ROWS UNBOUNDED PRECEDING) AS c, sum(w * y) OVER (PARTITION BY segment, year) AS mu FROM s),
g AS (SELECT segment, year, sum(p.w * q.w * abs(p.y - q.y)) AS d FROM s p JOIN s q USING (segment, year) GROUP BY ALL)
SELECT segment, year, count(*) AS n, round_even(round_even(any_value(mu), 8), 6) AS mean, round_even(any_value(d) / (2 * any_value(mu)), 6) AS gini, round_even(sum(w * y / mu * ln(y / mu)), 6) AS theil_t,
 round_even(sum(w * ln(mu / y)), 6) AS theil_l, round_even(sqrt(sum(w * (y - mu) * (y - mu))) / any_value(mu), 6) AS cv,
 round_even(1 - pow(sum(w * sqrt(y)), 2) / any_value(mu), 6) AS atkinson_0_5, round_even(1 - exp(sum(w * ln(y))) / any_value(mu), 6) AS atkinson_1, round_even(1 - (1 / sum(w / y)) / any_value(mu), 6) AS atkinson_2,
 round_even({pct(90)} / {pct(10)}, 6) AS p90_p10, round_even({pct(80)} / {pct(20)}, 6) AS p80_p20
FROM r JOIN g USING (segment, year) GROUP BY segment, year"""


@query("inequality_index_family_unweighted", _family_sql("1"))
def inequality_index_family_unweighted(spark, sf_dir) -> DataFrame:
    return M.index_family(regional_cells(spark, sf_dir), ["segment", "year"], "value")


@query("inequality_index_family_weighted", _family_sql("population"))
def inequality_index_family_weighted(spark, sf_dir) -> DataFrame:
    cells = regional_cells(spark, sf_dir).join(F.broadcast(population(spark, sf_dir)), "nationkey")
    return M.index_family(cells, ["segment", "year"], "value", "population")


@query("dispersion_complete_groups", f"""WITH {CELLS}, k AS (SELECT *, count(*) OVER g AS units, row_number() OVER (PARTITION BY segment, year ORDER BY value) AS r FROM cells WINDOW g AS (PARTITION BY segment, year))
SELECT segment, year, CAST(max(units) AS BIGINT) AS units, max(units) = {UNITS} AS complete,
 round_even(CASE WHEN max(units) = {UNITS} THEN stddev_pop(value) / avg(value) END, 6) AS cv,
 round_even(CASE WHEN max(units) = {UNITS} THEN avg(value) FILTER (r > units - 3) / avg(value) FILTER (r <= 3) END, 6) AS tail_ratio,
 round_even(CASE WHEN max(units) = {UNITS} THEN max(value) / min(value) END, 6) AS max_min FROM k GROUP BY segment, year""")
def dispersion_complete_groups(spark, sf_dir) -> DataFrame:
    """Dispersion of complete groups; an incomplete group keeps its row, with nulls."""
    r = M.ranked(regional_cells(spark, sf_dir), ["segment", "year"], "value", None)
    full = F.max("_n") == UNITS
    return r.groupBy("segment", "year").agg(
        F.max("_n").cast("bigint").alias("units"), full.alias("complete"), M.publish(F.when(full, M.variation())).alias("cv"),
        M.publish(F.when(full, M.tail_ratio())).alias("tail_ratio"), M.publish(F.when(full & (F.min("_y") > 0), F.try_divide(F.max("_y"), F.min("_y")))).alias("max_min"),
    )


@query("weighted_step_percentile", f"""WITH {CELLS}, s AS (SELECT segment, year, value AS y, population, sum(population) OVER (PARTITION BY segment, year ORDER BY value, population ROWS UNBOUNDED PRECEDING) / sum(population) OVER (PARTITION BY segment, year) AS c FROM cells JOIN pop USING (nationkey))
SELECT segment, year, CAST(q AS INT) AS q, round_even(coalesce(min(y) FILTER (round_even(c, 12) >= q / 100), max(y)), 6) AS percentile FROM s, (VALUES (10), (25), (50), (75), (90)) AS v(q) GROUP BY ALL""")
def weighted_step_percentile(spark, sf_dir) -> DataFrame:
    """Observed values at weighted percentiles: one pass, five conditional minima, unpivoted."""
    qs = (10, 25, 50, 75, 90)
    cells = regional_cells(spark, sf_dir).join(F.broadcast(population(spark, sf_dir)), "nationkey")
    wide = M.ranked(cells, ["segment", "year"], "value", "population").groupBy("segment", "year").agg(*[M.publish(M.step_percentile(q)).alias(str(q)) for q in qs])
    return wide.unpivot(["segment", "year"], [str(q) for q in qs], "q", "percentile").withColumn("q", F.col("q").cast("int"))


@query("weighted_quantile_interpolated", f"""WITH {CELLS}, s AS (SELECT segment, year, value AS y, population AS p, population / sum(population) OVER g AS w FROM cells JOIN pop USING (nationkey) WINDOW g AS (PARTITION BY segment, year)),
m AS (SELECT *, sum(w) OVER o - w / 2 AS m FROM s WINDOW o AS (PARTITION BY segment, year ORDER BY y, p ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, lead(m) OVER o AS m2, lead(y) OVER o AS y2, lag(m) OVER o AS m0 FROM m WINDOW o AS (PARTITION BY segment, year ORDER BY y, p))
SELECT segment, year, CAST(q AS DOUBLE) AS q, round_even(max(CASE WHEN q >= m AND q < m2 THEN y + (q - m) * (y2 - y) / (m2 - m) WHEN m0 IS NULL AND q < m THEN y WHEN m2 IS NULL AND q >= m THEN y END), 6) AS quantile
FROM n, (VALUES (0.1), (0.5), (0.9)) AS v(q) GROUP BY ALL""")
def weighted_quantile_interpolated(spark, sf_dir) -> DataFrame:
    cells = regional_cells(spark, sf_dir).join(F.broadcast(population(spark, sf_dir)), "nationkey")
    return M.weighted_quantile(cells, ["segment", "year"], "value", "population", [0.1, 0.5, 0.9])


_LORENZ = f"""WITH {CELLS}, s AS (SELECT segment, year, row_number() OVER o AS k, sum(CAST(population AS DOUBLE)) OVER (PARTITION BY segment, year ORDER BY value, population ROWS UNBOUNDED PRECEDING) / sum(population) OVER g AS population,
 sum(population * value) OVER (PARTITION BY segment, year ORDER BY value, population ROWS UNBOUNDED PRECEDING) / sum(population * value) OVER g AS share
 FROM cells JOIN pop USING (nationkey) WINDOW g AS (PARTITION BY segment, year), o AS (PARTITION BY segment, year ORDER BY value, population)),
l AS (SELECT segment, year, k, round_even(population, 6) AS population, round_even(share, 6) AS share FROM s UNION ALL SELECT DISTINCT segment, year, 0, 0.0, 0.0 FROM s)"""


@query("lorenz_curve", _LORENZ + " SELECT segment, year, CAST(k AS BIGINT) AS k, population, share FROM l")
def lorenz_curve(spark, sf_dir) -> DataFrame:
    cells = regional_cells(spark, sf_dir).join(F.broadcast(population(spark, sf_dir)), "nationkey")
    return M.lorenz(cells, ["segment", "year"], "value", "population")


@query("least_served_half", _LORENZ + """, n AS (SELECT *, lead(population) OVER o AS p2, lead(share) OVER o AS s2 FROM l WINDOW o AS (PARTITION BY segment, year ORDER BY k))
SELECT segment, year, round_even(share + (0.5 - population) * (s2 - share) / (p2 - population), 6) AS lower_share FROM n WHERE population <= 0.5 AND p2 > 0.5""")
def least_served_half(spark, sf_dir) -> DataFrame:
    cells = regional_cells(spark, sf_dir).join(F.broadcast(population(spark, sf_dir)), "nationkey")
    return M.least_served(cells, ["segment", "year"], "value", "population")


@query("baseline_rank", f"""WITH {CELLS}, b AS (SELECT segment, nation, avg(value) FILTER (year < {CUTOFF}) AS pre, avg(value) FILTER (year >= {CUTOFF}) AS post FROM cells GROUP BY ALL)
SELECT segment, nation, round_even(pre, 4) AS pre, round_even(post, 4) AS post, CAST(rank() OVER (PARTITION BY segment ORDER BY round_even(pre, 4) DESC NULLS LAST) AS INT) AS baseline_rank FROM b""")
def baseline_rank(spark, sf_dir) -> DataFrame:
    """Means before and after the cutoff, and the descending rank of the first."""
    mean = lambda p: F.bround(F.avg(F.when(period("year") == p, F.col("value"))), 4)
    b = regional_cells(spark, sf_dir).groupBy("segment", "nation").agg(mean("pre").alias("pre"), mean("post").alias("post"))
    return b.withColumn("baseline_rank", F.rank().over(Window.partitionBy("segment").orderBy(F.desc_nulls_last("pre"))))


#: Units that are reported together with a parent (child, parent).
MERGED = {"NATION_3": "NATION_2", "NATION_7": "NATION_6"}


@query("constant_geography_all_or_nothing_sum", f"""WITH {CELLS}, x AS (SELECT segment, year, CASE nation WHEN 'NATION_3' THEN 'NATION_2' WHEN 'NATION_7' THEN 'NATION_6' ELSE nation END AS unit, value, CASE WHEN nationkey % 5 = 2 AND year % 2 = 0 THEN NULL ELSE population END AS population FROM cells JOIN pop USING (nationkey))
SELECT segment, year, unit, CAST(count(*) AS BIGINT) AS parts, round_even(CASE WHEN count(value) = count(*) THEN sum(value) END, 4) AS value, CAST(CASE WHEN count(population) = count(*) THEN sum(population) END AS BIGINT) AS population FROM x GROUP BY ALL""")
def constant_geography_all_or_nothing_sum(spark, sf_dir) -> DataFrame:
    """Children recoded to their parents; a sum is null as soon as one of its parts is."""
    t = regional_cells(spark, sf_dir).join(F.broadcast(population(spark, sf_dir)), "nationkey")
    unit = F.coalesce(F.create_map(*[F.lit(x) for kv in MERGED.items() for x in kv])[F.col("nation")], F.col("nation"))
    known = F.when(~((F.col("nationkey") % 5 == 2) & (F.col("year") % 2 == 0)), F.col("population"))
    t = t.select("segment", "year", unit.alias("unit"), "value", known.alias("population"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    return t.groupBy("segment", "year", "unit").agg(F.count("*").cast("bigint").alias("parts"), F.bround(whole("value"), 4).alias("value"), whole("population").cast("bigint").alias("population"))


@query("yoy_change_rank", f"""WITH {CELLS}, d AS (SELECT segment, nation, year, value - lag(value) OVER (PARTITION BY segment, nation ORDER BY year) AS change FROM cells),
s AS (SELECT segment, nation, CAST(count(change) AS BIGINT) AS steps, round_even(avg(CASE WHEN change > 0 THEN 1.0 ELSE 0.0 END) FILTER (change IS NOT NULL), 6) AS rising, round_even(avg(change), 4) AS mean_change FROM d GROUP BY ALL)
SELECT *, round_even(rank() OVER (PARTITION BY segment ORDER BY rising DESC NULLS LAST) + (count(*) OVER (PARTITION BY segment, rising) - 1) / 2.0, 1) AS average_rank FROM s""")
def yoy_change_rank(spark, sf_dir) -> DataFrame:
    """Year-on-year changes, the share of rises, and descending ranks with ties averaged."""
    lag = F.lag("value").over(Window.partitionBy("segment", "nation").orderBy("year"))
    d = regional_cells(spark, sf_dir).withColumn("change", F.col("value") - lag)
    up = F.avg(F.when(F.col("change").isNotNull(), F.when(F.col("change") > 0, 1.0).otherwise(0.0)))
    s = d.groupBy("segment", "nation").agg(F.count("change").cast("bigint").alias("steps"), M.publish(up).alias("rising"), F.bround(F.avg("change"), 4).alias("mean_change"))
    ties = F.count("*").over(Window.partitionBy("segment", "rising"))
    return s.withColumn("average_rank", F.bround(F.rank().over(Window.partitionBy("segment").orderBy(F.desc_nulls_last("rising"))) + (ties - 1) / 2.0, 1))


@query("region_shares_of_total", """SELECT r_name AS region, CAST(count(*) AS BIGINT) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def region_shares_of_total(spark, sf_dir) -> DataFrame:
    """The geography dimension: units by region."""
    return geography(spark, sf_dir).groupBy("region").agg(F.count("*").cast("bigint").alias("nations"))
