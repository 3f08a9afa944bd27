"""Weighted least squares of any width as one aggregate: normal equations, solved natively, and their sandwich.

The products of a design's columns are summed by group with partial aggregation, whatever the number of rows. The small
matrix of a group is scaled to a unit diagonal and inverted by elimination on arrays; a pivot that vanishes means that the columns
are not independent, and the inverse is null. Coefficients and each row's influence on one of them follow by a join on the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A scaled pivot below this has vanished.
PIVOT = 1e-10
KERNELS = {"triangular": lambda u: F.greatest(1 - F.abs(u), F.lit(0.0)), "uniform": lambda u: F.when(F.abs(u) <= 1, 1.0).otherwise(0.0)}
LAGS = 12


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _inverse(m: Column, k: int) -> Column:
    """Inverse of a symmetric positive matrix (an array of rows); null where a pivot vanishes."""
    scale = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.try_divide(F.lit(1.0), F.sqrt(F.get(F.get(m, i), i))))
    wide = F.transform(m, lambda row, i: F.concat(
        F.zip_with(row, scale, lambda x, s: x * s * F.get(scale, i)), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0)),
    ))

    def step(a: Column, i: Column) -> Column:
        pivot = F.get(F.get(a, i), i)
        first = F.transform(F.get(a, i), lambda x: x / pivot)
        others = F.transform(a, lambda row, j: F.when(j == i, first).otherwise(F.zip_with(row, first, lambda x, f: x - F.get(row, i) * f)))
        return F.when(pivot > PIVOT, others)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), wide, step)
    return F.transform(done, lambda row, i: F.zip_with(F.slice(row, k + 1, k), scale, lambda x, s: x * s * F.get(scale, i)))


def solved(df: DataFrame, keys: list[str], x: list[Column], y: Column, w: Column) -> DataFrame:
    """keys, inverse (array of rows) and beta of the weighted regression of y on x in each group; null where x is not of full rank."""
    k = len(x)
    df = df.select(*keys, F.array(*[c.cast("double") for c in x]).alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"))
    at = lambda i: F.col("x")[i]
    sums = {f"s{i}_{j}": F.sum(F.col("w") * at(i) * at(j)) for i in range(k) for j in range(i, k)} | {f"t{i}": F.sum(F.col("w") * at(i) * F.col("y")) for i in range(k)}
    got = df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    matrix = F.array(*[F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    got = got.select(*keys, F.array(*[F.col(f"t{i}") for i in range(k)]).alias("xy"), _inverse(matrix, k).alias("inverse"))
    return got.select(*keys, "inverse", F.transform("inverse", lambda row: dot(row, F.col("xy"))).alias("beta"))


def design(running: Column, bandwidth: Column, degree: int, controls: list[str]) -> list[Column]:
    """Powers of the scaled running variable, the jump (at degree + 1), the same powers beyond the cutoff, controls."""
    u, right = running / bandwidth, F.when(running >= 0, 1.0).otherwise(0.0)
    power = lambda i: F.pow(u, F.lit(float(i))) if i else F.lit(1.0)
    return [*[power(i) for i in range(degree + 1)], *[right * power(i) for i in range(degree + 1)], *[F.col(c) for c in controls]]


def local_polynomial(df: DataFrame, keys: list[str], y: str, *, degree: int = 1, kernel: str = "triangular", controls: tuple[str, ...] = (), lags: int = LAGS) -> DataFrame:
    """The jump at the cutoff (tau), its HAC error, counts, worst-case bias for a unit of curvature, and why a window is refused.

    df has ``running`` and ``bandwidth``, and its rows lie in their windows; keys include the bandwidth. A row
    without outcome or control is left out; a group without any gives no row; periods that are equal keep an order by outcome.
    """
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    for c in controls:
        known = known & F.col(c).isNotNull()
    r, h = F.col("running").cast("double"), F.col("bandwidth").cast("double")
    x = design(F.col("_r"), F.col("_h"), degree, list(controls))
    k = len(x)
    df = df.where(known).withColumns({"_r": r, "_h": h, "_y": F.col(y).cast("double")}).withColumn("_k", KERNELS[kernel](F.col("_r") / F.col("_h")))
    fits = solved(df, keys, x, F.col("_y"), F.col("_k")).select(*keys, "beta", F.get("inverse", F.lit(degree + 1)).alias("jump"))
    rows = df.select(*keys, "_r", "_y", "_k", F.array(*[c.cast("double") for c in x]).alias("_x")).join(fits, keys)
    rows = rows.withColumn("_w", F.col("_k") * dot(F.col("_x"), F.col("jump"))).withColumn("_psi", F.col("_w") * (F.col("_y") - dot(F.col("_x"), F.col("beta"))))
    line = Window.partitionBy(*keys).orderBy("_r", "_y")
    rows = rows.withColumns({f"_p{i}": F.col("_psi") * F.lag("_psi", i).over(line) for i in range(1, lags + 1)})
    n, eff = F.count("*"), F.count_if(F.col("_k") > 0)
    used = F.least(F.lit(lags), F.greatest(F.floor(n / 4).cast("int"), F.lit(1)))
    variance = F.sum(F.col("_psi") * F.col("_psi"))
    for i in range(1, lags + 1):
        variance = variance + F.when(used >= i, 2 * (1 - F.lit(float(i)) / (used + 1)) * F.coalesce(F.sum(f"_p{i}"), F.lit(0.0))).otherwise(0.0)
    few = 2 * (degree + 2)
    refused = (
        F.when(n < few, "too few observations").when(eff <= few, "too few weighted observations")
        .when(F.max(F.col("beta").isNull()), "rank-deficient design").when(eff - k < 5, "too few residual degrees of freedom")
    )
    ok = refused.isNull()
    return rows.groupBy(*keys).agg(
        F.when(ok, F.sum(F.col("_w") * F.col("_y"))).alias("tau"), F.when(ok, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("se"),
        F.count_if(F.col("_r") < 0).cast("int").alias("n_left"), F.count_if(F.col("_r") >= 0).cast("int").alias("n_right"),
        F.when(ok, F.sum(F.abs("_w") * F.col("_r") * F.col("_r")) / 2).alias("bias_per_m"), refused.alias("refused"),
    )
