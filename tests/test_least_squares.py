"""Least squares of any width against plain matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regioscope.operators import least_squares as LS


def plain(r, y, h, degree, kernel, controls):
    """(tau, se) by matrices."""
    right = (r >= 0).astype(float)
    x = np.column_stack([*[(r / h) ** p for p in range(degree + 1)], *[right * (r / h) ** p for p in range(degree + 1)], *controls])
    k = np.clip(1 - np.abs(r) / h, 0, None) if kernel == "triangular" else np.ones(len(r))
    bread = np.linalg.inv(x.T @ (x * k[:, None]))
    beta = bread @ (x.T @ (k * y))
    s = x * (k * (y - x @ beta))[:, None]
    lags = min(12, max(len(r) // 4, 1))
    meat = s.T @ s + sum((1 - i / (lags + 1)) * (s[i:].T @ s[:-i] + s[:-i].T @ s[i:]) for i in range(1, lags + 1))
    return beta[degree + 1], np.sqrt((bread @ meat @ bread)[degree + 1, degree + 1])


def frame(spark, r, y, h, **more):
    names = ["running", "y", "bandwidth", *more]
    return spark.createDataFrame([tuple(float(v) for v in t) for t in zip(r, y, np.full(len(r), h), *more.values(), strict=True)], ", ".join(f"{n} double" for n in names)).withColumn("series", F.lit("a"))


@pytest.mark.parametrize("degree,kernel,control", [(1, "triangular", False), (1, "uniform", True), (2, "triangular", True), (3, "uniform", False)])
def test_matrices(spark, degree, kernel, control):
    rng = np.random.default_rng(degree)
    r = np.arange(-30, 30).astype(float)
    y, c = 0.03 * r + 2.5 * (r >= 0) + rng.normal(size=60), rng.normal(size=60)
    df = frame(spark, r, y, 30, c=c)
    got = LS.local_polynomial(df, ["series", "bandwidth"], "y", degree=degree, kernel=kernel, controls=("c",) if control else ()).first()
    tau, se = plain(r, y, 30, degree, kernel, [c] if control else [])
    assert got.tau == pytest.approx(tau, abs=1e-8) and got.se == pytest.approx(se, abs=1e-8) and (got.n_left, got.n_right, got.refused) == (30, 30, None)


def test_exact_for_its_own_shape(spark):
    r = np.arange(-24, 25).astype(float)
    quadratic = frame(spark, r, 0.4 * r**2 - r + 2.5 * (r >= 0) * (1 + r), 24)
    assert LS.local_polynomial(quadratic, ["series", "bandwidth"], "y", degree=2).first().tau == pytest.approx(2.5, abs=1e-8)
    assert abs(LS.local_polynomial(quadratic, ["series", "bandwidth"], "y").first().tau - 2.5) > 1


def test_refusals(spark):
    r = np.arange(-12, 12).astype(float)
    why = lambda df, **kw: LS.local_polynomial(df, ["series", "bandwidth"], "y", **kw).first()
    same = why(frame(spark, r, r, 12, c=2 * r + 1), controls=("c",))
    assert same.refused == "rank-deficient design" and same.tau is None and same.se is None
    assert why(frame(spark, r[:5], r[:5], 12)).refused == "too few observations"
    assert why(frame(spark, r[8:15], r[8:15], 3)).refused == "too few weighted observations"
    assert why(frame(spark, r[8:16], r[8:16], 12)).refused == "too few residual degrees of freedom"
    assert why(frame(spark, np.abs(r), r, 12)).refused == "rank-deficient design"
    empty = frame(spark, r, np.full(24, np.nan), 12)
    assert LS.local_polynomial(empty, ["series", "bandwidth"], "y").count() == 0
