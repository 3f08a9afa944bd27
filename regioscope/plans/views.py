"""Published views over the regional cells: ratios to the nation, gaps, shifts, spreads and their medians.

All of them aggregate before they join or pivot; what is ranked or pivoted has one row by region, segment and year at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import measures as M
from ..sources.tables import CELLS, geography, population, regional_cells
from .regional import CUTOFF, region_inequality_decomposition, _PAIRS
from .series import BASES, _BASED, _UNIT, based, unit_prices

#: The pair of indicators that is compared, the years of a shift, the regions of the first group.
PAIR = ("BUILDING", "HOUSEHOLD")
SHIFT = (1996, 2000)
FIRST_GROUP = ("AMERICA", "EUROPE")

_MEAN = "CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value)"  # exact cents, divided once

_zero = lambda e: f"round_even({e}, 6) + 0.0"


@query("region_to_nation", f"""WITH {CELLS}, r AS (SELECT year, region, {_MEAN} AS m FROM cells GROUP BY ALL), n AS (SELECT year, {_MEAN} AS mu FROM cells GROUP BY ALL)
SELECT year, region, {_zero('100 * m / mu')} AS ratio, {_zero('m - mu')} AS difference FROM r JOIN n USING (year)""")
def region_to_nation(spark, sf_dir) -> DataFrame:
    """A region's mean against the nation's, as ratio and as difference, on the years both have."""
    parts = regional_cells(spark, sf_dir).groupBy("year", "region").agg(F.sum(M.cents("value")).alias("s"), F.count("value").alias("n"))
    w = Window.partitionBy("year")
    m, mu = M.mean_of_cents(F.col("s"), F.col("n")), M.mean_of_cents(F.sum("s").over(w), F.sum("n").over(w))
    return parts.select("year", "region", M.publish(100 * F.try_divide(m, mu)).alias("ratio"), M.publish(m - mu).alias("difference"))


@query("pair_ratio", f"""WITH {CELLS}, p AS (SELECT year, region, sum(value) FILTER (segment = '{PAIR[0]}') AS a, sum(value) FILTER (segment = '{PAIR[1]}') AS b FROM cells GROUP BY ALL)
SELECT year, region, {_zero('100 * a / b')} AS ratio FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def pair_ratio(spark, sf_dir) -> DataFrame:
    """One indicator over another, by year and region, where both are known."""
    wide = regional_cells(spark, sf_dir).where(F.col("segment").isin(*PAIR)).groupBy("year", "region").pivot("segment", list(PAIR)).agg(F.sum("value"))
    return wide.dropna(subset=list(PAIR)).select("year", "region", M.publish(100 * F.try_divide(*PAIR)).alias("ratio"))


@query("share_gap", f"""WITH {CELLS}, v AS (SELECT year, region, sum(value) AS v FROM cells GROUP BY ALL), p AS (SELECT r_name AS region, sum(population) AS p FROM pop JOIN nation ON nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT year, region, {_zero('100 * v / sum(v) OVER (PARTITION BY year) - 100 * p / (SELECT sum(p) FROM p)')} AS gap FROM v JOIN p USING (region)""")
def share_gap(spark, sf_dir) -> DataFrame:
    """Share of value less share of population, by region and year."""
    v = regional_cells(spark, sf_dir).groupBy("year", "region").agg(F.sum("value").alias("v"))
    p = population(spark, sf_dir).join(F.broadcast(geography(spark, sf_dir)), "nationkey").groupBy("region").agg(F.sum("population").alias("p"))
    p = p.select("region", (100 * F.try_divide("p", F.sum("p").over(Window.partitionBy(F.lit(0))))).alias("people"))  # a row by region
    value = 100 * F.try_divide("v", F.sum("v").over(Window.partitionBy("year")))
    return v.withColumn("value", value).join(F.broadcast(p), "region").select("year", "region", M.publish(F.col("value") - F.col("people")).alias("gap"))


@query("budget_shift", f"""WITH {CELLS}, s AS (SELECT region, segment, sum(value) FILTER (year = {SHIFT[0]}) AS a, sum(value) FILTER (year = {SHIFT[1]}) AS b FROM cells GROUP BY ALL)
SELECT region, segment, {_zero('100 * b / sum(b) OVER (PARTITION BY region) - 100 * a / sum(a) OVER (PARTITION BY region)')} AS shift FROM s""")
def budget_shift(spark, sf_dir) -> DataFrame:
    """Change of each indicator's share of a region's total between two years."""
    at = lambda y: F.sum(F.when(F.col("year") == y, F.col("value")))
    s = regional_cells(spark, sf_dir).groupBy("region", "segment").agg(at(SHIFT[0]).alias("a"), at(SHIFT[1]).alias("b"))
    share = lambda c: 100 * F.try_divide(c, F.sum(c).over(Window.partitionBy("region")))
    return s.select("region", "segment", M.publish(share("b") - share("a")).alias("shift"))


@query("parallel_trends", f"""WITH {CELLS}, c AS (SELECT *, region IN {FIRST_GROUP} AS f FROM cells), h AS (SELECT segment, year, f, {_MEAN} AS m FROM c GROUP BY ALL),
g AS (SELECT segment, year, max(m) FILTER (NOT f) - max(m) FILTER (f) AS gap FROM h GROUP BY ALL)
SELECT segment, year, {_zero('gap')} AS gap, {_zero(f'regr_slope(gap, year - {CUTOFF}) FILTER (year < {CUTOFF}) OVER (PARTITION BY segment)')} AS pre_slope FROM g""")
def parallel_trends(spark, sf_dir) -> DataFrame:
    """Gap between the means of two groups of regions, and its slope before the cutoff.

    Sums of cents are exact, a mean is divided once and rounded once, to more digits than a tie of cents can have.
    """
    first = F.col("region").isin(*FIRST_GROUP)
    mean = lambda on: M.mean_of_cents(F.sum(F.when(on, M.cents("value"))), F.count_if(on & F.col("value").isNotNull()))
    g = regional_cells(spark, sf_dir).groupBy("segment", "year").agg((mean(~first) - mean(first)).alias("gap"))
    before = F.regr_slope(F.when(F.col("year") < CUTOFF, F.col("gap")), (F.col("year") - CUTOFF).cast("double")).over(Window.partitionBy("segment"))
    return g.select("segment", "year", M.publish(F.col("gap")).alias("gap"), M.publish(before).alias("pre_slope"))


@query("spread_by_year", f"""WITH {CELLS} SELECT segment, year, {_zero('max(value) / min(value)')} AS max_min, {_zero('quantile_cont(value, 0.75) / quantile_cont(value, 0.25)')} AS p75_p25, round_even(max(value) - min(value), 2) AS span, arg_max(nation, value) AS highest
FROM cells GROUP BY segment, year""")
def spread_by_year(spark, sf_dir) -> DataFrame:
    """Extremes and quartiles of the units, the span, and the unit that leads (25 units in a group at most)."""
    v = F.col("value")
    quartiles = F.try_divide(F.percentile(v, 0.75), F.percentile(v, 0.25))
    return regional_cells(spark, sf_dir).groupBy("segment", "year").agg(
        M.publish(F.try_divide(F.max(v), F.min(v))).alias("max_min"), M.publish(quartiles).alias("p75_p25"), F.bround(F.max(v) - F.min(v), 2).alias("span"), F.max_by("nation", v).alias("highest"),
    )


@query("median_gini", f"""WITH {CELLS}, g AS {_PAIRS.format(t='cells')}, d AS (SELECT *, gini - lag(gini) OVER (PARTITION BY segment ORDER BY year) AS change FROM g)
SELECT year, {_zero('median(gini)')} AS median_gini, {_zero('median(change)')} AS median_change, {_zero('avg(CASE WHEN change < 0 THEN 1.0 WHEN change IS NOT NULL THEN 0.0 END)')} AS fell FROM d GROUP BY year""")
def median_gini(spark, sf_dir) -> DataFrame:
    """Median Gini over the indicators by year, the median change and the share of indicators that fell."""
    g = region_inequality_decomposition(spark, sf_dir).select("segment", "year", F.col("gini_nation").alias("gini"))
    change = F.col("gini") - F.lag("gini").over(Window.partitionBy("segment").orderBy("year"))
    fell = F.when(F.col("change") < 0, 1.0).when(F.col("change").isNotNull(), 0.0)
    return g.withColumn("change", change).groupBy("year").agg(M.publish(F.median("gini")).alias("median_gini"), M.publish(F.median("change")).alias("median_change"), M.publish(F.avg(fell)).alias("fell"))


@query("year_pivot", f"""WITH {CELLS} SELECT year, {', '.join(f"round_even(sum(value) FILTER (region = '{r}'), 2) AS {r.lower().replace(' ', '_')}" for r in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))} FROM cells GROUP BY year""")
def year_pivot(spark, sf_dir) -> DataFrame:
    """A year by row and a region by column."""
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = regional_cells(spark, sf_dir).groupBy("year").pivot("region", regions).agg(F.sum("value"))
    return wide.select("year", *[F.bround(F.col(f"`{r}`"), 2).alias(r.lower().replace(" ", "_")) for r in regions])


@query("index_of_one_base", f"""WITH {_BASED} SELECT function_code, year, round_even(i, 6) AS "index" FROM ib WHERE i IS NOT NULL""")
def index_of_one_base(spark, sf_dir) -> DataFrame:
    """The price index on its newest base alone."""
    return based(unit_prices(spark, sf_dir), BASES[1], 2001).dropna(subset=["index"]).select("function_code", "year", M.publish(F.col("index")).alias("index"))


@query("price_against_budget", f"""WITH {_UNIT}, s AS (SELECT *, 100 * spent / sum(spent) OVER (PARTITION BY year) AS share FROM u),
p AS (SELECT function_code, max(price) FILTER (year = {SHIFT[0]}) AS p0, max(price) FILTER (year = {SHIFT[1]}) AS p1, max(share) FILTER (year = {SHIFT[0]}) AS s0, max(share) FILTER (year = {SHIFT[1]}) AS s1 FROM s GROUP BY ALL)
SELECT function_code, {_zero('100 * (p1 / p0 - 1)')} AS price_change, {_zero('s1 - s0')} AS share_change FROM p WHERE p0 IS NOT NULL AND p1 IS NOT NULL""")
def price_against_budget(spark, sf_dir) -> DataFrame:
    """Change of a function's price against the change of its share of spending, where both years are known."""
    share = 100 * F.try_divide("spent", F.sum("spent").over(Window.partitionBy("year")))  # a row by function in each year
    at = lambda c, y: F.max(F.when(F.col("year") == y, F.col(c)))
    s = unit_prices(spark, sf_dir).withColumn("share", share).groupBy("function_code").agg(*[at(c, y).alias(f"{c}{i}") for c in ("price", "share") for i, y in enumerate(SHIFT)])
    return s.dropna(subset=["price0", "price1"]).select("function_code", M.publish(100 * (F.try_divide("price1", "price0") - 1)).alias("price_change"), M.publish(F.col("share1") - F.col("share0")).alias("share_change"))
