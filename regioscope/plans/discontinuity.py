"""Breaks at the cutoff: local-linear estimates, honest intervals, placebos, permutations, recovered weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import measures as M
from ..operators import rdit
from ..sources.tables import geography, population, table
from .series import RUNNING, monthly

BANDWIDTHS, DONUTS = [6, 12, 24, 36], [0, 1]
SMOOTHNESS = 0.001


def _rd_sql(source: str, keys: str, y: str) -> str:
    """The estimate by explicit sums; ``source`` has keys, running, bandwidth and y in their windows."""
    lags = "".join(f" + CASE WHEN least(12, greatest(count(*) // 4, 1)) >= {i} THEN 2 * (1 - {i}.0 / (least(12, greatest(count(*) // 4, 1)) + 1)) * coalesce(sum(psi * l{i}), 0) ELSE 0 END" for i in range(1, 13))
    cols = ", ".join(f"lag(psi, {i}) OVER o AS l{i}" for i in range(1, 13))
    return f"""k AS (SELECT *, CAST(running AS DOUBLE) AS r, greatest(1 - abs(running) / CAST(bandwidth AS DOUBLE), 0) AS k, running >= 0 AS rt FROM {source} WHERE {y} IS NOT NULL),
sd AS (SELECT *, sum(k) OVER s AS s0, sum(k * r) OVER s AS s1, sum(k * r * r) OVER s AS s2, sum(k * {y}) OVER s AS t0, sum(k * r * {y}) OVER s AS t1 FROM k WINDOW s AS (PARTITION BY {keys}, rt)),
wt AS (SELECT *, CASE WHEN rt THEN 1 ELSE -1 END * k * (s2 - s1 * r) / (s0 * s2 - s1 * s1) AS w, {y} - (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) - (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) * r AS e FROM sd),
ps AS (SELECT *, w * e AS psi FROM wt), lg AS (SELECT *, {cols} FROM ps WINDOW o AS (PARTITION BY {keys} ORDER BY r)),
fit AS (SELECT {keys}, count(*) AS n, count(*) FILTER (k > 0) AS eff, sum(w * {y}) AS tau, sqrt(greatest(sum(psi * psi){lags}, 0)) AS se, CAST(count(*) FILTER (r < 0) AS INT) AS n_left, CAST(count(*) FILTER (r >= 0) AS INT) AS n_right, sum(abs(w) * r * r) / 2 AS bias_per_m,
 CASE WHEN count(*) < 6 THEN 'too few observations' WHEN count(*) FILTER (k > 0) <= 6 THEN 'too few weighted observations' WHEN count(*) FILTER (k > 0) - 4 < 5 THEN 'too few residual degrees of freedom' END AS refused FROM lg GROUP BY {keys})"""


_GRID = f"""WITH {RUNNING}, gr AS (SELECT ms.*, CAST(h AS INT) AS bandwidth, CAST(d AS INT) AS donut FROM ms, (VALUES (6), (12), (24), (36)) AS a(h), (VALUES (0), (1)) AS b(d) WHERE abs(running) <= h AND abs(running) >= d), """


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdit.local_linear(rdit.grid(monthly(spark, sf_dir), BANDWIDTHS, DONUTS), ["series", "bandwidth", "donut"], "log_value")


@query("rd_local_linear", _GRID + _rd_sql("gr", "series, bandwidth, donut", "log_value") + " SELECT series, bandwidth, donut, round_even(round_even(CASE WHEN refused IS NULL THEN tau END, 10), 6) AS tau, round_even(round_even(CASE WHEN refused IS NULL THEN se END, 10), 6) AS se, n_left, n_right, refused FROM fit")
def rd_local_linear(spark, sf_dir) -> DataFrame:
    e = _estimates(spark, sf_dir)
    num = lambda c: M.publish(F.bround(c, 10)).alias(c)  # noqa: E731  logs have six decimals: ties at the sixth are met first
    return e.select("series", "bandwidth", "donut", num("tau"), num("se"), "n_left", "n_right", "refused")


@query("rd_worst_case_bias", _GRID + _rd_sql("gr", "series, bandwidth, donut", "log_value") + f" SELECT series, bandwidth, donut, round_even(CASE WHEN refused IS NULL THEN bias_per_m * {SMOOTHNESS} END, 6) AS worst_case_bias FROM fit")
def rd_worst_case_bias(spark, sf_dir) -> DataFrame:
    return _estimates(spark, sf_dir).select("series", "bandwidth", "donut", M.publish(F.col("bias_per_m") * SMOOTHNESS).alias("worst_case_bias"))


_PLACEBO = f"""WITH {RUNNING}, gr AS (SELECT series, running - c AS running, log_value, CAST(c AS INT) AS cutoff, 12 AS bandwidth FROM ms, generate_series(-18, 18, 6) AS t(c) WHERE abs(running - c) <= 12), """


@query("rd_placebo_sweep", _PLACEBO + _rd_sql("gr", "series, cutoff, bandwidth", "log_value") + """, p AS (SELECT series, cutoff, tau FROM fit WHERE refused IS NULL)
SELECT series, cutoff, round_even(tau, 6) AS tau, round_even(avg(CASE WHEN abs(tau) >= abs((SELECT any_value(q.tau) FROM p q WHERE q.series = p.series AND q.cutoff = 0)) - 1e-12 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY series), 6) AS share_as_large FROM p""")
def rd_placebo_sweep(spark, sf_dir) -> DataFrame:
    """The same estimate at placebo cutoffs, and how many are as large as the true one."""
    m = monthly(spark, sf_dir).select("series", "running", "log_value")
    m = m.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in range(-18, 19, 6)]))).withColumn("running", F.col("running") - F.col("cutoff")).withColumn("bandwidth", F.lit(12)).where("abs(running) <= 12")
    e = rdit.local_linear(m, ["series", "cutoff", "bandwidth"], "log_value").where("refused is null")
    w = Window.partitionBy("series")
    true = F.max(F.when(F.col("cutoff") == 0, F.abs("tau"))).over(w)
    share = F.avg(F.when(F.abs("tau") >= true - 1e-12, 1.0).otherwise(0.0)).over(w)
    return e.select("series", "cutoff", M.publish(F.col("tau")).alias("tau"), M.publish(share).alias("share_as_large"))


def _by_series(df: DataFrame, schema: str, f) -> DataFrame:
    """One small pandas problem for each series, on its periods in order."""
    return df.groupBy("series").applyInPandas(lambda pdf: f(pdf.sort_values("running").reset_index(drop=True)), schema)


@query("rd_honest_interval")
def rd_honest_interval(spark, sf_dir) -> DataFrame:
    """Intervals that absorb the curvature each series shows globally."""
    m = monthly(spark, sf_dir).select("series", "running", "log_value")
    bound = _by_series(m, "series string, smoothness double", lambda p: pd.DataFrame({"series": [p.series[0]], "smoothness": [rdit.smoothness(p.running.to_numpy(float), p.log_value.to_numpy(float))]}))
    e = _estimates(spark, sf_dir).join(F.broadcast(bound), "series").withColumn("worst_case_bias", F.col("bias_per_m") * F.col("smoothness"))
    e = rdit.honest(e)
    num = ["tau", "se", "smoothness", "worst_case_bias", "honest_lo", "honest_hi"]
    return e.select("series", "bandwidth", "donut", *[M.publish(F.col(c)).alias(c) for c in num], "honest_excludes_zero", "bias_exceeds_estimate", "n_left", "n_right", "refused")


@query("rd_deseasonalised")
def rd_deseasonalised(spark, sf_dir) -> DataFrame:
    """Local-linear estimates on series without their month effects."""

    def adjust(p: pd.DataFrame) -> pd.DataFrame:
        return p[["series", "running"]].assign(adjusted=rdit.deseasonalise(p.running.to_numpy(float), p.log_value.to_numpy(float), p.month.to_numpy()))

    a = _by_series(monthly(spark, sf_dir).where("log_value is not null").select("series", "running", "month", "log_value"), "series string, running int, adjusted double", adjust)
    e = rdit.local_linear(rdit.grid(a, BANDWIDTHS, DONUTS), ["series", "bandwidth", "donut"], "adjusted")
    return e.select("series", "bandwidth", "donut", M.publish(F.col("tau")).alias("tau"), M.publish(F.col("se")).alias("se"), "n_left", "n_right", "refused")


@query("rd_cv_bandwidth")
def rd_cv_bandwidth(spark, sf_dir) -> DataFrame:
    def choose(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series": [p.series[0]], "bandwidth": [rdit.cross_validated_bandwidth(p.running.to_numpy(float), p.log_value.to_numpy(float), list(range(4, 37, 2)))]})

    return _by_series(monthly(spark, sf_dir).select("series", "running", "log_value"), "series string, bandwidth double", choose)


@query("permutation_test")
def permutation_test(spark, sf_dir) -> DataFrame:
    """Permutation p-values by window, with the least p the window can give."""

    def test(p: pd.DataFrame) -> pd.DataFrame:
        rows = [(p.series[0], w, *rdit.permutation(p.running.to_numpy(float), p.log_value.to_numpy(float), w)) for w in (1, 3, 6, 9)]
        return pd.DataFrame(rows, columns=["series", "window", "p_value", "periods", "p_floor", "refused"])

    return _by_series(monthly(spark, sf_dir).select("series", "running", "log_value"), "series string, window int, p_value double, periods int, p_floor double, refused string", test)


@query("permutation_floor", """WITH w AS (SELECT CAST(w AS INT) AS window_, 2 * w + 1 AS n, w + 1 AS k FROM generate_series(1, 8) AS t(w)) SELECT window_ AS "window", CAST(n AS INT) AS periods, round_even(1.0 / round(factorial(CAST(n AS INT)) / (factorial(CAST(k AS INT)) * factorial(CAST(n - k AS INT)))), 12) AS p_floor FROM w""")
def permutation_floor(spark, sf_dir) -> DataFrame:
    """The least p-value a symmetric window with one period at the cutoff can give."""
    n, k = 2 * F.col("window") + 1, F.col("window") + 1
    total = F.round(F.factorial(n) / (F.factorial(k) * F.factorial(n - k)))
    return spark.range(1, 9).select(F.col("id").cast("int").alias("window")).select("window", n.cast("int").alias("periods"), F.bround(1 / total, 12).alias("p_floor"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean spending of each brand by the supplier's region, as five columns."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"), F.count("*").alias("n"))
    p, s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("product")), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    x = by.join(p, by.l_partkey == p.p_partkey).join(s, by.l_suppkey == s.s_suppkey).join(F.broadcast(geography(spark, sf_dir)), F.col("s_nationkey") == F.col("nationkey"))
    return x.groupBy("product", "region").agg(F.try_divide(F.sum("v"), F.sum("n")).alias("value"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = population(spark, sf_dir).join(F.broadcast(geography(spark, sf_dir)), "nationkey").groupBy("region").agg(F.sum("population").alias("people"))
    return p


@query("spatial_gini_by_product", """WITH w AS (SELECT r_name AS region, count(*) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
x AS (SELECT p_brand AS product, r_name AS region, sum(l_extendedprice) / count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
y AS (SELECT product, value, people / sum(people) OVER (PARTITION BY product) AS w FROM x JOIN w USING (region)), m AS (SELECT product, sum(w * value) AS mu, count(*) AS n FROM y GROUP BY ALL)
SELECT product, CAST(any_value(n) AS BIGINT) AS regions, round_even(sum(a.w * b.w * abs(a.value - b.value)) / (2 * any_value(mu)), 6) AS gini FROM y a JOIN y b USING (product) JOIN m USING (product) GROUP BY product""")
def spatial_gini_by_product(spark, sf_dir) -> DataFrame:
    x = _products(spark, sf_dir).join(F.broadcast(_weights(spark, sf_dir)), "region")
    return M.ranked(x, ["product"], "value", "people").groupBy("product").agg(F.max("_n").cast("bigint").alias("regions"), M.publish(M.gini_of_ranked()).alias("gini"))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def printed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows by product with a printed national figure: the weighted mean, wrong in a fixed few."""
    x = _products(spark, sf_dir).join(F.broadcast(_weights(spark, sf_dir)), "region")
    wide = x.groupBy("product").pivot("region", list(REGIONS)).agg(F.first("value"))
    national = x.groupBy("product").agg(F.try_divide(F.sum(F.col("value") * F.col("people")), F.sum("people")).alias("national"))
    wrong = F.substring("product", -1, 1) == "7"
    return wide.join(national, "product").dropna().withColumn("national", F.col("national") * F.when(wrong, 1.3).otherwise(1.0))


def least_squares(df: DataFrame, columns: tuple[str, ...], target: str) -> np.ndarray:
    """Coefficients without intercept: the products are summed in one distributed aggregate, only their small matrix is solved here."""
    c = [F.col(f"`{x}`") for x in columns]
    k = len(c)
    row = df.agg(*[F.sum(a * b) for a in c for b in c], *[F.sum(a * F.col(target)) for a in c]).first()
    if row[0] is None:
        raise ValueError("no rows to fit")
    v = np.array(row, float)
    return np.round(np.linalg.solve(v[: k * k].reshape(k, k), v[k * k :]), 6)


def reject_and_refit(df: DataFrame, columns: tuple[str, ...] = REGIONS, target: str = "national", tolerance: float = 0.02, floor: float = 50.0) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(kept, refused with reason, weights of the kept): fit, refuse rows that their own columns contradict, refit."""
    first = least_squares(df, columns, target)
    implied = sum(F.col(f"`{c}`") * float(w) for c, w in zip(columns, first, strict=True))
    df = df.withColumn("implied", implied).withColumn("_ok", F.abs(implied - F.col(target)) <= F.greatest(F.col(target) * tolerance, F.lit(floor)))
    kept = df.where("_ok").drop("_ok", "implied")
    refused = df.where("not _ok").drop("_ok").withColumn("reason", F.lit("printed national contradicts its own regions"))
    return kept, refused, least_squares(kept, columns, target)


@query("recovered_shares")
def recovered_shares(spark, sf_dir) -> DataFrame:
    """Weights of the regions, fitted on all rows and again without the refused ones."""
    df = printed_products(spark, sf_dir)
    first = least_squares(df, REGIONS, "national")
    *_, second = reject_and_refit(df, floor=1.0)
    return spark.createDataFrame([(r, float(a), float(b)) for r, a, b in zip(REGIONS, first, second, strict=True)], "region string, first_fit double, refit double")


@query("reject_refit")
def reject_refit(spark, sf_dir) -> DataFrame:
    """The refused rows with what their regions imply."""
    _, refused, _ = reject_and_refit(printed_products(spark, sf_dir), floor=1.0)
    return refused.select("product", M.publish(F.col("national")).alias("national"), M.publish(F.col("implied")).alias("implied"), "reason")


@query("identify_columns", """WITH m AS (SELECT r_name AS region, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
t AS (SELECT CAST(row_number() OVER (ORDER BY v) AS INT) AS position, 1000 * v AS total FROM m), j AS (SELECT position, region, count(*) OVER (PARTITION BY position) AS a, count(*) OVER (PARTITION BY region) AS b FROM t JOIN m ON abs(total / 1000 - v) <= 1.0)
SELECT t.position, round_even(total, 4) AS total, CASE WHEN a = 1 AND b = 1 THEN region END AS region, CASE WHEN a IS NULL THEN 'matches nothing' WHEN a > 1 OR b > 1 THEN 'not identified' END AS refused FROM t LEFT JOIN (SELECT position, min(region) AS region, max(a) AS a, max(b) AS b FROM j GROUP BY ALL) USING (position)""")
def identify_columns(spark, sf_dir) -> DataFrame:
    """Columns named by matching their total to published means within one unit, one to one; the rest are refused.

    A range join on buckets of the tolerance's width: a total meets its own bucket and both neighbours.
    """
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    m = c.join(F.broadcast(geography(spark, sf_dir)), F.col("c_nationkey") == F.col("nationkey")).groupBy("region").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("v"))
    t = m.select(F.row_number().over(Window.orderBy("v")).alias("position"), (1000 * F.col("v")).alias("total"))  # one row by region
    left = t.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("total") / 1000) + d for d in (-1, 0, 1)])))
    j = left.join(m.withColumn("bucket", F.floor("v")), "bucket").where(F.abs(F.col("total") / 1000 - F.col("v")) <= 1.0)
    j = j.withColumns({"a": F.count("*").over(Window.partitionBy("position")), "b": F.count("*").over(Window.partitionBy("region"))})
    j = j.groupBy("position").agg(F.min("region").alias("r"), F.max("a").alias("a"), F.max("b").alias("b"))
    refused = F.when(F.col("a").isNull(), "matches nothing").when((F.col("a") > 1) | (F.col("b") > 1), "not identified")
    return t.join(j, "position", "left").select("position", F.bround("total", 4).alias("total"), F.when(refused.isNull(), F.col("r")).alias("region"), refused.alias("refused"))
