"""Estimates by least squares of any width: other degrees, kernels, controls, grids, one-sided curves, counterfactuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import measures as M
from ..operators import least_squares as LS
from ..operators import rdit
from ..sources.tables import CELLS, regional_cells, table
from .discontinuity import DONUTS
from .regional import CUTOFF
from .series import RUNNING, monthly, running

#: Bandwidths in months and in years, the half-width of a local curve.
WIDE = [12, 18, 24, 36]
ANNUAL = [2, 3, 4]
CURVE = 12


def solve_sql(source: str, keys: str, x: list[str], y: str, w: str) -> str:
    """CTEs gm (products), el (elimination) and sv (keys, a with the inverse in its last columns, beta) for a regression of any width."""
    k = len(x)
    m = "[" + ", ".join("[" + ", ".join(f"sum({w} * ({a}) * ({b}))" for b in x) + "]" for a in x) + "]"
    v = "[" + ", ".join(f"sum({w} * ({a}) * {y})" for a in x) + "]"
    return f"""gm AS (SELECT {keys}, {m} AS m, {v} AS v FROM {source} GROUP BY {keys}),
el AS (SELECT {keys}, v, list_transform(m, lambda row, i: list_concat(row, list_transform(range(1, {k + 1}), lambda j: CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE 0 END))) AS a, 1 AS i FROM gm
 UNION ALL SELECT {keys}, v, list_transform(a, lambda row, j: CASE WHEN j = i THEN list_transform(row, lambda z: z / a[i][i]) ELSE list_transform(row, lambda z, c: z - row[i] * a[i][c] / a[i][i]) END), i + 1 FROM el WHERE i <= {k}),
sv AS (SELECT {keys}, list_transform(a, lambda row: row[{k + 1}:]) AS inv, list_transform(a, lambda row: list_dot_product(row[{k + 1}:], v)) AS beta FROM el WHERE i = {k + 1})"""


def jump_sql(source: str, keys: str, y: str, degree: int, kernel: str, controls: list[str]) -> str:
    """CTE fit: the estimate by elimination and explicit sums; ``source`` has keys, running, bandwidth, y and controls in their windows."""
    power = [f"pow(u, {i})" for i in range(degree + 1)]
    x = [*power, *[f"CASE WHEN r >= 0 THEN {p} ELSE 0 END" for p in power], *controls]
    few, k = 2 * (degree + 2), len(x)
    used = "least(12, greatest(count(*) // 4, 1))"
    lags = "".join(f" + CASE WHEN {used} >= {i} THEN 2 * (1 - {i}.0 / ({used} + 1)) * coalesce(sum(psi * l{i}), 0) ELSE 0 END" for i in range(1, 13))
    weight = "greatest(1 - abs(u), 0)" if kernel == "triangular" else "CASE WHEN abs(u) <= 1 THEN 1.0 ELSE 0.0 END"
    return f"""bs AS (SELECT *, CAST(running AS DOUBLE) AS r, CAST(running AS DOUBLE) / bandwidth AS u, {y} AS yy FROM {source} WHERE {y} IS NOT NULL), ks AS (SELECT *, {weight} AS k FROM bs),
{solve_sql('ks', keys, x, 'yy', 'k')},
wt AS (SELECT ks.*, k * list_dot_product([{', '.join(f'CAST({c} AS DOUBLE)' for c in x)}], inv[{degree + 2}]) AS w, yy - list_dot_product([{', '.join(f'CAST({c} AS DOUBLE)' for c in x)}], beta) AS e FROM ks JOIN sv USING ({keys})),
ps AS (SELECT *, w * e AS psi FROM wt), lg AS (SELECT *, {', '.join(f'lag(psi, {i}) OVER o AS l{i}' for i in range(1, 13))} FROM ps WINDOW o AS (PARTITION BY {keys} ORDER BY r, yy)),
fit AS (SELECT {keys}, CASE WHEN count(*) < {few} THEN 'too few observations' WHEN count(*) FILTER (k > 0) <= {few} THEN 'too few weighted observations' WHEN count(*) FILTER (k > 0) - {k} < 5 THEN 'too few residual degrees of freedom' END AS refused,
 sum(w * yy) AS tau, sqrt(greatest(sum(psi * psi){lags}, 0)) AS se, CAST(count(*) FILTER (r < 0) AS INT) AS n_left, CAST(count(*) FILTER (r >= 0) AS INT) AS n_right FROM lg GROUP BY {keys})"""


_PUBLISHED = "CASE WHEN refused IS NULL THEN round_even(round_even(tau, 10), 6) + 0.0 END AS tau, CASE WHEN refused IS NULL THEN round_even(round_even(se, 10), 6) + 0.0 END AS se, n_left, n_right, refused FROM fit"
_WIDE = f"WITH RECURSIVE {RUNNING}, gr AS (SELECT ms.*, CAST(h AS INT) AS bandwidth, CAST(d AS INT) AS donut FROM ms, (VALUES (12), (18), (24), (36)) AS a(h), (VALUES (0), (1)) AS b(d) WHERE abs(running) <= h AND abs(running) >= d), "


def _published(e: DataFrame, *keys: str) -> DataFrame:
    num = lambda c: M.publish(F.bround(c, 10)).alias(c)  # noqa: E731  values have six decimals: ties at the sixth are met first
    return e.select(*keys, num("tau"), num("se"), "n_left", "n_right", "refused")


def _windows(spark, sf_dir) -> DataFrame:
    return rdit.grid(monthly(spark, sf_dir), WIDE, DONUTS)


_KEYS = ["series", "bandwidth", "donut"]


@query("rd_local_quadratic", _WIDE + jump_sql("gr", "series, bandwidth, donut", "log_value", 2, "triangular", []) + f" SELECT series, bandwidth, donut, {_PUBLISHED}")
def rd_local_quadratic(spark, sf_dir) -> DataFrame:
    """The jump where the mean may bend on either side."""
    return _published(LS.local_polynomial(_windows(spark, sf_dir), _KEYS, "log_value", degree=2), *_KEYS)


@query("rd_uniform_kernel", _WIDE + jump_sql("gr", "series, bandwidth, donut", "log_value", 1, "uniform", []) + f" SELECT series, bandwidth, donut, {_PUBLISHED}")
def rd_uniform_kernel(spark, sf_dir) -> DataFrame:
    """The jump with all periods of a window weighed alike."""
    return _published(LS.local_polynomial(_windows(spark, sf_dir), _KEYS, "log_value", kernel="uniform"), *_KEYS)


@query("rd_with_control", _WIDE + jump_sql("gr", "series, bandwidth, donut", "log_value", 1, "triangular", ["month"]) + f" SELECT series, bandwidth, donut, {_PUBLISHED}")
def rd_with_control(spark, sf_dir) -> DataFrame:
    """The jump beside a control, here the month's place in its year."""
    return _published(LS.local_polynomial(_windows(spark, sf_dir), _KEYS, "log_value", controls=("month",)), *_KEYS)


_PRICES = """pr AS (SELECT p_brand AS outcome, CAST((year(l_shipdate) - 1998) * 12 + month(l_shipdate) - 7 AS INT) AS running, round_even(ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query("rd_price_grid", f"WITH RECURSIVE {_PRICES}, gr AS (SELECT pr.*, CAST(h AS INT) AS bandwidth FROM pr, (VALUES (12), (18), (24), (36)) AS a(h) WHERE abs(running) <= h), {jump_sql('gr', 'outcome, bandwidth', 'y', 1, 'triangular', [])} SELECT outcome, bandwidth, {_PUBLISHED}")
def rd_price_grid(spark, sf_dir) -> DataFrame:
    """The jump of each brand's monthly unit price, in logs."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey", running(F.year("l_shipdate"), F.month("l_shipdate")).cast("int").alias("running")).agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))  # noqa: E741
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("outcome"))
    y = F.bround(F.log(F.try_divide(F.sum("v"), F.sum("q"))), 6)
    prices = l.join(p, l.l_partkey == p.p_partkey).groupBy("outcome", "running").agg(y.alias("y"))
    keys = ["outcome", "bandwidth"]
    return _published(LS.local_polynomial(rdit.grid(prices, WIDE, [0]), keys, "y"), *keys)


@query("rd_annual_grid", f"WITH RECURSIVE {CELLS}, an AS (SELECT segment AS outcome, CAST(year - {CUTOFF} AS INT) AS running, round_even(ln(sum(value)), 6) AS y FROM cells GROUP BY ALL), gr AS (SELECT an.*, CAST(h AS INT) AS bandwidth FROM an, (VALUES (2), (3), (4)) AS a(h) WHERE abs(running) <= h), {jump_sql('gr', 'outcome, bandwidth', 'y', 1, 'uniform', [])} SELECT outcome, bandwidth, {_PUBLISHED}")
def rd_annual_grid(spark, sf_dir) -> DataFrame:
    """The same design on annual values, where most windows hold too little and say so."""
    years = regional_cells(spark, sf_dir).groupBy(F.col("segment").alias("outcome"), (F.col("year") - CUTOFF).cast("int").alias("running")).agg(F.bround(F.log(F.sum("value")), 6).alias("y"))
    keys = ["outcome", "bandwidth"]
    return _published(LS.local_polynomial(rdit.grid(years, ANNUAL, [0]), keys, "y", kernel="uniform"), *keys)


_SIDE = "(r.running >= 0) = (p.running >= 0)"


@query("one_sided_curve", f"""WITH {RUNNING}, b AS (SELECT p.series, p.running, r.log_value AS y, CAST(r.running - p.running AS DOUBLE) AS g, 1 - abs(r.running - p.running) / {CURVE}.0 AS k FROM ms p JOIN ms r ON p.series = r.series AND {_SIDE} AND abs(r.running - p.running) < {CURVE} WHERE r.log_value IS NOT NULL),
s AS (SELECT series, running, count(*) AS n, sum(k) AS s0, sum(k * g) AS s1, sum(k * g * g) AS s2, sum(k * y) AS t0, sum(k * g * y) AS t1 FROM b GROUP BY ALL)
SELECT series, running, n, round_even(round_even((t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1), 10), 6) AS fitted FROM s WHERE n >= 3""")
def one_sided_curve(spark, sf_dir) -> DataFrame:
    """A local line at every period from the periods of its own side: each row goes to the points within reach, so no rows are paired."""
    m = monthly(spark, sf_dir).select("series", "running", "log_value").where("log_value is not null")
    reach = m.withColumn("at", F.explode(F.sequence(F.col("running") - (CURVE - 1), F.col("running") + (CURVE - 1)))).where((F.col("running") >= 0) == (F.col("at") >= 0))
    points = monthly(spark, sf_dir).select("series", F.col("running").alias("at"))
    g = (F.col("running") - F.col("at")).cast("double")
    fits = LS.solved(reach, ["series", "at"], [F.lit(1.0), g], F.col("log_value"), 1 - F.abs(g) / CURVE)
    n = reach.groupBy("series", "at").agg(F.count("*").alias("n"))
    got = fits.join(n, ["series", "at"]).join(points, ["series", "at"]).where("n >= 3")
    return got.select("series", F.col("at").alias("running"), "n", M.publish(F.bround(F.get("beta", F.lit(0)), 10)).alias("fitted"))


#: Name, first year of the window, degree of each pre-trend that is carried forward.
TRENDS = (("linear", 0, 1), ("quadratic", 0, 2), ("late linear", 1995, 1))


def _trend_sql(i: int, name: str, first: int, degree: int) -> str:
    x = [f"pow(z, {p})" for p in range(degree + 1)]
    at = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in x) + "]"
    solve = solve_sql(f"w{i}", "segment", x, "y", "1.0").replace("gm AS", f"gm{i} AS").replace("FROM gm", f"FROM gm{i}").replace("el AS", f"el{i} AS").replace("FROM el", f"FROM el{i}").replace("sv AS", f"sv{i} AS")
    return f"""w{i} AS (SELECT * FROM nv WHERE z < 0 AND z >= {first - CUTOFF if first else -99}), {solve},
v{i} AS (SELECT segment, CASE WHEN count(*) > {degree + 1} THEN sum(pow(y - list_dot_product({at}, beta), 2)) / (count(*) - {degree + 1}) END AS s2 FROM w{i} JOIN sv{i} USING (segment) GROUP BY ALL),
o{i} AS (SELECT segment, CAST(z + {CUTOFF} AS INT) AS year, '{name}' AS trend, y, list_dot_product({at}, beta) AS f, 1.96 * sqrt(s2 * (1 + list_dot_product({at}, list_transform(inv, lambda row: list_dot_product(row, {at}))))) AS half FROM nv JOIN sv{i} USING (segment) JOIN v{i} USING (segment) WHERE z >= 0)"""


@query("counterfactuals", f"WITH RECURSIVE {CELLS}, nv AS (SELECT segment, CAST(year - {CUTOFF} AS DOUBLE) AS z, sum(value) / 1e6 AS y FROM cells GROUP BY ALL), " + ", ".join(_trend_sql(i, *t) for i, t in enumerate(TRENDS))
       + " SELECT segment, year, trend, round_even(f, 6) AS fitted, round_even(y - f, 6) AS effect, round_even(f - half, 6) AS low, round_even(f + half, 6) AS high FROM (" + " UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(len(TRENDS))) + ")")
def counterfactuals(spark, sf_dir) -> DataFrame:
    """Three pre-trends carried beyond the cutoff, with prediction intervals: what the break is said to have done depends on the choice."""
    z = (F.col("year") - CUTOFF).cast("double")
    years = regional_cells(spark, sf_dir).groupBy("segment", z.alias("z")).agg((F.sum("value") / 1e6).alias("y"))
    out = None
    for name, first, degree in TRENDS:
        x = [F.pow("z", F.lit(float(p))) for p in range(degree + 1)]
        before = years.where((F.col("z") < 0) & (F.col("z") >= (first - CUTOFF if first else -99)))
        fits = LS.solved(before, ["segment"], x, F.col("y"), F.lit(1.0))
        at = F.array(*x)
        spare = F.count("*") - (degree + 1)
        s2 = before.join(fits, "segment").groupBy("segment").agg(F.when(spare > 0, F.sum(F.pow(F.col("y") - LS.dot(at, F.col("beta")), F.lit(2.0))) / spare).alias("s2"))
        got = years.where("z >= 0").join(fits, "segment").join(s2, "segment")
        fitted = LS.dot(at, F.col("beta"))
        half = 1.96 * F.sqrt(F.col("s2") * (1 + LS.dot(at, F.transform("inverse", lambda row: LS.dot(row, at)))))
        got = got.select(
            "segment", (F.col("z") + CUTOFF).cast("int").alias("year"), F.lit(name).alias("trend"), M.publish(fitted).alias("fitted"), M.publish(F.col("y") - fitted).alias("effect"),
            M.publish(fitted - half).alias("low"), M.publish(fitted + half).alias("high"),
        )
        out = got if out is None else out.union(got)
    return out


@query("pre_trend_residuals", f"""WITH {CELLS}, nv AS (SELECT segment, CAST(year - {CUTOFF} AS DOUBLE) AS z, sum(value) / 1e6 AS y FROM cells GROUP BY ALL), f AS (SELECT *, regr_slope(y, z) FILTER (z < 0) OVER (PARTITION BY segment) AS b, regr_intercept(y, z) FILTER (z < 0) OVER (PARTITION BY segment) AS a FROM nv)
SELECT segment, CAST(z + {CUTOFF} AS INT) AS year, round_even(y - a - b * z, 6) AS residual, z >= 0 AS treated FROM f""")
def pre_trend_residuals(spark, sf_dir) -> DataFrame:
    """Every year's distance from the line through the years before the cutoff."""
    z = (F.col("year") - CUTOFF).cast("double")
    years = regional_cells(spark, sf_dir).groupBy("segment", z.alias("z")).agg((F.sum("value") / 1e6).alias("y"))
    before = Window.partitionBy("segment")
    y, x = F.when(F.col("z") < 0, F.col("y")), F.when(F.col("z") < 0, F.col("z"))
    line = F.regr_intercept(y, x).over(before) + F.regr_slope(y, x).over(before) * F.col("z")
    return years.select("segment", (F.col("z") + CUTOFF).cast("int").alias("year"), M.publish(F.col("y") - line).alias("residual"), (F.col("z") >= 0).alias("treated"))
