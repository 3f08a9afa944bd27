"""Series: running variables, deflation, chaining, rebasing, trends before and after a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import measures as M
from ..sources.tables import CELLS, regional_cells, table
from .checks import _MONTHS, months
from .regional import CUTOFF

#: Month of the cutoff, first years of the two index bases, limits of a chain.
CUTOFF_MONTH = (1998, 7)
BASES = (1995, 1998)
CHAIN_STEP, CHAIN_GAP = 0.35, 0.01

_RUN = f"((year - {CUTOFF_MONTH[0]}) * 12 + month - {CUTOFF_MONTH[1]})"


def running(year, month):
    return (year - CUTOFF_MONTH[0]) * 12 + month - CUTOFF_MONTH[1]


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly value by series with the running variable, treatment and log (null where not positive); the unfinished last month is left out."""
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("last"))
    unfinished = F.when(F.to_date("last") < F.last_day("last"), F.year("last") * 12 + F.month("last"))
    end = last.select(F.coalesce(unfinished, F.lit(0)).alias("open_month"))  # one number
    m = months(spark, sf_dir).crossJoin(F.broadcast(end)).where(F.col("year") * 12 + F.col("month") != F.col("open_month"))
    r = running(F.col("year"), F.col("month"))
    return m.select(
        "series", "year", "month", r.cast("int").alias("running"), M.publish(F.col("year") + (F.col("month") - 1) / F.lit(12.0)).alias("t"),
        (r >= 0).alias("treated"), F.bround("value", 2).alias("value"), M.publish(F.when(F.col("value") > 0, F.log("value"))).alias("log_value"),
    )


RUNNING = f"""{_MONTHS}, ms AS (SELECT series, year, month, CAST({_RUN} AS INT) AS running, round_even(year + (month - 1) / 12.0, 6) AS t, {_RUN} >= 0 AS treated, round_even(value, 2) AS value, round_even(CASE WHEN value > 0 THEN ln(value) END, 6) AS log_value
 FROM m, (SELECT max(CAST(l_shipdate AS DATE)) AS last FROM lineitem) WHERE last = last_day(last) OR year <> year(last) OR month <> month(last))"""


@query("monthly_running_series", f"WITH {RUNNING} SELECT *, CAST(count(*) OVER (PARTITION BY series, year) AS BIGINT) AS months_in_year FROM ms")
def monthly_running_series(spark, sf_dir) -> DataFrame:
    return monthly(spark, sf_dir).withColumn("months_in_year", F.count("*").over(Window.partitionBy("series", "year")).cast("bigint"))


_UNIT = """u AS (SELECT p_type AS function_code, CAST(year(l_shipdate) AS INT) AS year, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_extendedprice) AS spent FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))  # noqa: E741
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("function_code"))
    return l.join(p, l.l_partkey == p.p_partkey).groupBy("function_code", "year").agg(F.try_divide(F.sum("v"), F.sum("q")).alias("price"), F.sum("v").alias("spent"))


def based(df: DataFrame, base: int, last: int) -> DataFrame:
    """An index that reads 100 in its own base year, for the years that the base was published."""
    at = F.max(F.when(F.col("year") == base, F.col("price"))).over(Window.partitionBy("function_code"))
    return df.withColumn("index", 100 * F.try_divide(F.col("price"), at)).where(F.col("year").between(base, last)).select("function_code", "year", F.lit(base).alias("base_year"), "index")


_BASED = _UNIT + """, a AS (SELECT function_code, year, 100 * price / max(price) FILTER (year = 1995) OVER (PARTITION BY function_code) AS i FROM u), b AS (SELECT function_code, year, 100 * price / max(price) FILTER (year = 1998) OVER (PARTITION BY function_code) AS i FROM u),
ia AS (SELECT * FROM a WHERE year BETWEEN 1995 AND 1999), ib AS (SELECT * FROM b WHERE year BETWEEN 1998 AND 2001)"""


@query("chain_index", f"""WITH {_BASED}, f AS (SELECT function_code, avg(ib.i / ia.i) AS factor, count(*) AS overlap, max(ib.i / ia.i) / min(ib.i / ia.i) - 1 AS residual FROM ia JOIN ib USING (function_code, year) GROUP BY ALL)
SELECT function_code, year, round_even(coalesce(ib.i, ia.i * factor), 6) AS "index", ib.i IS NULL AS spliced, round_even(factor, 6) AS factor, CAST(overlap AS BIGINT) AS overlap, round_even(residual, 6) AS residual FROM ia FULL JOIN ib USING (function_code, year) JOIN f USING (function_code)""")
def chain_index(spark, sf_dir) -> DataFrame:
    """Splices the old base to the new one by the mean ratio of the overlap; a published value wins."""
    u = unit_prices(spark, sf_dir)
    old, new = based(u, BASES[0], 1999), based(u, BASES[1], 2001)
    both = old.unionByName(new).groupBy("function_code", "year").agg(F.max(F.when(F.col("base_year") == BASES[0], F.col("index"))).alias("a"), F.max(F.when(F.col("base_year") == BASES[1], F.col("index"))).alias("b"))
    w = Window.partitionBy("function_code")
    ratio = F.try_divide("b", "a")
    both = both.withColumns({"factor": F.avg(ratio).over(w), "overlap": F.count(ratio).over(w), "residual": F.try_divide(F.max(ratio).over(w), F.min(ratio).over(w)) - 1})
    return both.where("overlap > 0").select(
        "function_code", "year", M.publish(F.coalesce("b", F.col("a") * F.col("factor"))).alias("index"), F.col("b").isNull().alias("spliced"), M.publish(F.col("factor")).alias("factor"), F.col("overlap").cast("bigint").alias("overlap"), M.publish(F.col("residual")).alias("residual"),
    )


@query("chain_refusals", f"""WITH {_BASED}, f AS (SELECT function_code, avg(ib.i / ia.i) AS factor, count(*) AS overlap, max(ib.i / ia.i) / min(ib.i / ia.i) - 1 AS residual FROM ia JOIN ib USING (function_code, year) GROUP BY ALL),
c AS (SELECT function_code, year, coalesce(ib.i, ia.i * factor) AS i, overlap, residual FROM ia FULL JOIN ib USING (function_code, year) JOIN f USING (function_code)), s AS (SELECT *, abs(i / lag(i) OVER (PARTITION BY function_code ORDER BY year) - 1) AS step FROM c)
SELECT function_code, CAST(count(*) AS BIGINT) AS years, max(overlap) >= 2 AS overlap_ok, max(step) <= 0.35 AS step_ok, max(residual) <= 0.01 AS agreement_ok FROM s GROUP BY function_code""")
def chain_refusals(spark, sf_dir) -> DataFrame:
    """Checks of a chain by function: overlap, largest step, disagreement of the overlap years."""
    step = F.abs(F.try_divide(F.col("index"), F.lag("index").over(Window.partitionBy("function_code").orderBy("year"))) - 1)
    c = chain_index(spark, sf_dir).withColumn("step", step)
    return c.groupBy("function_code").agg(F.count("*").cast("bigint").alias("years"), (F.max("overlap") >= 2).alias("overlap_ok"), (F.max("step") <= CHAIN_STEP).alias("step_ok"), (F.max("residual") <= CHAIN_GAP).alias("agreement_ok"))


@query("rebasing_ratio", f"""WITH {_BASED} SELECT function_code, year, round_even(ib.i / ia.i, 6) AS ratio FROM ia JOIN ib USING (function_code, year)""")
def rebasing_ratio(spark, sf_dir) -> DataFrame:
    u = unit_prices(spark, sf_dir)
    both = based(u, BASES[0], 1999).unionByName(based(u, BASES[1], 2001)).groupBy("function_code", "year").pivot("base_year", list(BASES)).agg(F.first("index"))
    return both.where(f"`{BASES[0]}` is not null and `{BASES[1]}` is not null").select("function_code", "year", M.publish(F.try_divide(str(BASES[1]), str(BASES[0]))).alias("ratio"))


@query("deflate_nominal", f"""WITH {CELLS}, {_UNIT}, t AS (SELECT year, sum(spent) / sum(spent / price) AS p FROM u GROUP BY ALL), d AS (SELECT year, 100 * p / max(p) FILTER (year = 1998) OVER () AS deflator FROM t)
SELECT segment, year, nation, round_even(CASE WHEN segment IN ('AUTOMOBILE', 'BUILDING') THEN value / (deflator / 100) ELSE value END, 2) AS value, CASE WHEN segment IN ('AUTOMOBILE', 'BUILDING') THEN 'constant prices' ELSE 'as printed' END AS unit FROM cells JOIN d USING (year)""")
def deflate_nominal(spark, sf_dir) -> DataFrame:
    """Only nominal indicators are deflated and relabelled; the deflator is a small table by year."""
    t = unit_prices(spark, sf_dir).groupBy("year").agg(F.try_divide(F.sum("spent"), F.sum(F.col("spent") / F.col("price"))).alias("p"))
    base = t.where(f"year = {CUTOFF}").select(F.col("p").alias("p0"))
    d = t.crossJoin(F.broadcast(base)).select("year", (100 * F.col("p") / F.col("p0")).alias("deflator"))  # one row by year with one number
    nominal = F.col("segment").isin("AUTOMOBILE", "BUILDING")
    c = regional_cells(spark, sf_dir).join(F.broadcast(d), "year", "left")
    known = F.coalesce("deflator", F.raise_error(F.concat(F.lit("no deflator for the year "), F.col("year").cast("string"))).cast("double"))
    return c.select("segment", "year", "nation", F.bround(F.when(nominal, F.try_divide(F.col("value"), known / 100)).otherwise(F.col("value")), 2).alias("value"), F.when(nominal, "constant prices").otherwise("as printed").alias("unit"))


def pre_post(df: DataFrame, keys: list[str], value: str, year: str = "year", cutoff: int = CUTOFF, min_pre: int = 3, min_post: int = 3) -> DataFrame:
    """Means on both sides, slope before, what it predicts after, and the excess; short windows are left out."""
    pre, post = F.col(year) < cutoff, F.col(year) >= cutoff
    x, y = F.col(year).cast("double"), F.col(value)
    side = lambda s, v: F.when(s & y.isNotNull(), v)
    g = df.groupBy(*keys).agg(
        F.count(side(pre, y)).cast("bigint").alias("n_pre"), F.count(side(post, y)).cast("bigint").alias("n_post"), F.avg(side(pre, y)).alias("pre"), F.avg(side(post, y)).alias("post"),
        F.regr_slope(side(pre, y), side(pre, x)).alias("slope"), F.regr_intercept(side(pre, y), side(pre, x)).alias("icpt"), F.avg(side(post, x)).alias("mid"),
    ).where((F.col("n_pre") >= min_pre) & (F.col("n_post") >= min_post))
    predicted = F.col("icpt") + F.col("slope") * F.col("mid")
    p = lambda c: F.bround(c, 8)  # noqa: E731  inputs have six decimals, so means and slopes of them meet ties at six
    return g.select(*keys, "n_pre", "n_post", p(F.col("pre")).alias("pre"), p(F.col("post")).alias("post"), p(10 * F.col("slope")).alias("slope_per_decade"), p(predicted).alias("predicted"), p(F.col("post") - predicted).alias("excess"))


_GINIS = f"""WITH {CELLS}, s AS (SELECT segment, year, value AS y, row_number() OVER o AS k, count(*) OVER g AS n, avg(value) OVER g AS mu FROM cells WINDOW g AS (PARTITION BY segment, year), o AS (PARTITION BY segment, year ORDER BY value)),
gi AS (SELECT segment, year, round_even(2 / any_value(mu) * sum(y / n * ((k - 0.5) / n - 0.5)), 6) AS gini FROM s GROUP BY ALL)"""


def ginis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranked(regional_cells(spark, sf_dir), ["segment", "year"], "value", None).groupBy("segment", "year").agg(M.publish(M.gini_of_ranked()).alias("gini"))


@query("pre_post_trend", _GINIS + f""", g AS (SELECT segment, count(*) FILTER (year < {CUTOFF}) AS n_pre, count(*) FILTER (year >= {CUTOFF}) AS n_post, avg(gini) FILTER (year < {CUTOFF}) AS pre, avg(gini) FILTER (year >= {CUTOFF}) AS post,
 regr_slope(gini, year) FILTER (year < {CUTOFF}) AS slope, regr_intercept(gini, year) FILTER (year < {CUTOFF}) AS icpt, avg(year) FILTER (year >= {CUTOFF}) AS mid FROM gi GROUP BY ALL)
SELECT segment, n_pre, n_post, round_even(pre, 8) AS pre, round_even(post, 8) AS post, round_even(10 * slope, 8) AS slope_per_decade, round_even(icpt + slope * mid, 8) AS predicted, round_even(post - icpt - slope * mid, 8) AS excess FROM g WHERE n_pre >= 3 AND n_post >= 3""")
def pre_post_trend(spark, sf_dir) -> DataFrame:
    return pre_post(ginis(spark, sf_dir), ["segment"], "gini")


@query("slope_break", _GINIS + f""" SELECT segment, CASE WHEN year >= {CUTOFF} THEN 'post' ELSE 'pre' END AS period, CAST(count(*) AS BIGINT) AS n, round_even(avg(gini), 8) AS level, round_even(10 * regr_slope(gini, year), 8) AS slope_per_decade FROM gi GROUP BY ALL""")
def slope_break(spark, sf_dir) -> DataFrame:
    """Level and slope on either side."""
    period = F.when(F.col("year") >= CUTOFF, "post").otherwise("pre")
    return ginis(spark, sf_dir).groupBy("segment", period.alias("period")).agg(F.count("*").cast("bigint").alias("n"), F.bround(F.avg("gini"), 8).alias("level"), F.bround(10 * F.regr_slope("gini", F.col("year").cast("double")), 8).alias("slope_per_decade"))


@query("segmented_level_shift_sweep", _GINIS + """ SELECT segment, CAST(b AS INT) AS break_year, round_even(regr_intercept(gini, year - b) FILTER (year >= b) - regr_intercept(gini, year - b) FILTER (year < b), 8) AS shift FROM gi, generate_series(1997, 2000) AS t(b) GROUP BY ALL""")
def segmented_level_shift_sweep(spark, sf_dir) -> DataFrame:
    """Level shift at each candidate break from two one-sided lines; one pass with every break."""
    g = ginis(spark, sf_dir).withColumn("break_year", F.explode(F.array(*[F.lit(b) for b in range(1997, 2001)])))
    x, after = (F.col("year") - F.col("break_year")).cast("double"), F.col("year") >= F.col("break_year")
    line = lambda s: F.regr_intercept(F.when(s, F.col("gini")), F.when(s, x))
    return g.groupBy("segment", "break_year").agg(F.bround(line(after) - line(~after), 8).alias("shift"))


@query("normalised_to_first", f"WITH {CELLS}, n AS (SELECT segment, year, sum(value) AS v FROM cells GROUP BY ALL) SELECT segment, year, round_even(100 * v / first_value(v) OVER (PARTITION BY segment ORDER BY year), 6) AS level FROM n")
def normalised_to_first(spark, sf_dir) -> DataFrame:
    n = regional_cells(spark, sf_dir).groupBy("segment", "year").agg(F.sum("value").alias("v"))
    return n.select("segment", "year", M.publish(100 * F.col("v") / F.first("v").over(Window.partitionBy("segment").orderBy("year"))).alias("level"))


@query("monthly_against_annual", f"WITH {_MONTHS} SELECT m.series, m.year, CAST(count(*) AS BIGINT) AS months, round_even(CAST(sum(CAST(m.value AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS monthly_mean, round_even(any_value(CAST(CAST(a.total AS DECIMAL(18, 2)) AS DOUBLE)) / 12, 6) AS annual, CASE WHEN count(*) = 12 THEN abs(avg(m.value) / (any_value(a.total) / 12) - 1) <= 0.005 END AS agrees FROM m LEFT JOIN a USING (series, year) GROUP BY ALL")
def monthly_against_annual(spark, sf_dir) -> DataFrame:
    """Mean of the months against the annual figure; judged only where all twelve are there."""
    total = F.sum(M.cents("value"))
    mean, annual = M.mean_of_cents(total, F.count("*")), M.mean_of_cents(total, F.lit(12))
    m = months(spark, sf_dir).groupBy("series", "year").agg(F.count("*").cast("bigint").alias("months"), mean.alias("mean"), annual.alias("annual"))
    return m.select("series", "year", "months", M.publish(F.col("mean")).alias("monthly_mean"), M.publish(F.col("annual")).alias("annual"), F.when(F.col("months") == 12, F.abs(F.try_divide("mean", "annual") - 1) <= 0.005).alias("agrees"))
