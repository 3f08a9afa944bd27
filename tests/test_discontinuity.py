"""Closed-form cases of the discontinuity operators, against a full design-matrix solve."""

import math

import numpy as np
import pytest

from regioscope.operators import rdit


def estimate(spark, y, h, donut=0, lo=-60, hi=60):
    rows = [("s", r, float(y(r)) if y(r) is not None else None) for r in range(lo, hi)]
    df = rdit.grid(spark.createDataFrame(rows, "s string, running int, y double"), [h], [donut])
    return rdit.local_linear(df, ["s", "bandwidth", "donut"], "y").first()


def test_jump_and_kink(spark):
    assert estimate(spark, lambda r: 0.03 * r + 2.5 * (r >= 0), 24).tau == pytest.approx(2.5)
    assert estimate(spark, lambda r: 0.03 * r + 0.2 * max(r, 0), 24).tau == pytest.approx(0, abs=1e-9)


def test_curve_shrinks(spark):
    y = lambda r: 0.03 * r + 4e-4 * r * r + 1e-5 * r**3
    assert abs(estimate(spark, y, 8).tau) < abs(estimate(spark, y, 36).tau) / 5


@pytest.mark.parametrize("h,donut", [(12, 0), (12, 1), (24, 1)])
def test_matches_full_solve(spark, h, donut):
    rng = np.random.default_rng(5)
    noise = {r: rng.normal() for r in range(-60, 60)}
    y = lambda r: 0.1 * r + 1.5 * (r >= 0) + noise[r]
    got = estimate(spark, y, h, donut)
    r = np.array([x for x in range(-60, 60) if donut <= abs(x) <= h], float)
    v = np.array([y(int(x)) for x in r])
    k = np.maximum(1 - abs(r) / h, 0)
    t = (r >= 0) * 1.0
    x = np.column_stack((np.ones_like(r), t, r, t * r))
    bread = np.linalg.inv(x.T @ (x * k[:, None]))
    beta = bread @ (x.T @ (k * v))
    psi = (bread @ (x * k[:, None]).T)[1] * (v - x @ beta)
    lags = min(12, max(len(r) // 4, 1))
    var = psi @ psi + sum(2 * (1 - i / (lags + 1)) * (psi[i:] @ psi[:-i]) for i in range(1, lags + 1))
    assert got.tau == pytest.approx(beta[1]) and got.se == pytest.approx(math.sqrt(max(var, 0)))


def test_refusals(spark):
    assert estimate(spark, lambda r: r, 2).refused == "too few observations"
    assert estimate(spark, lambda r: r, 3).refused == "too few weighted observations"
    assert estimate(spark, lambda r: r, 4).refused == "too few residual degrees of freedom"
    assert estimate(spark, lambda r: r, 20, lo=0).refused == "rank-deficient design"
    assert estimate(spark, lambda r: float(r) if r % 7 else None, 24).refused is None


def test_critical_values():
    assert rdit.critical_value(0) == pytest.approx(1.959964, abs=1e-5)
    seen = [rdit.critical_value(b) for b in (0, 0.5, 1, 2, 4, 8)]
    assert seen == sorted(seen) and seen[-1] == pytest.approx(8 + 1.644854, abs=1e-4)


def test_smoothness_and_season():
    r = np.arange(-60, 60.0)
    assert rdit.smoothness(r, 4e-4 * r * r) == pytest.approx(8e-4, rel=1e-6)
    month = (np.arange(120) % 12) + 1
    season = np.sin(month)
    y = 0.01 * r + 0.9 * (r >= 0)
    clean = rdit.deseasonalise(r, y + season, month)
    assert np.ptp(clean - y) < 1e-8


def test_bandwidth_choice():
    r = np.arange(-30, 30.0)
    assert rdit.cross_validated_bandwidth(r, 0.05 * r**2, [4, 8, 16]) == 4
    noise = np.random.default_rng(0).normal(size=60)
    assert rdit.cross_validated_bandwidth(r, noise + r, [4, 8, 24]) == 24


def test_permutation():
    r = np.arange(-3, 4.0)
    p, n, floor, why = rdit.permutation(r, 1000.0 * (r >= 0), 3)
    assert (p, n, why) == (pytest.approx(1 / 35), 7, None) and floor == pytest.approx(1 / 35)
    r = np.array([-3, -2, -1, 0, 1, 2.0])
    assert rdit.permutation(r, 1000.0 * (r >= 0), 3)[2] == pytest.approx(2 / 20)
    assert rdit.permutation(np.array([-1, 0.0]), np.array([1, 2.0]), 3)[3] == "under two periods on a side"
    wide = np.arange(-12, 13.0)
    a, b = (rdit.permutation(wide, np.sin(wide), 12) for _ in range(2))
    assert a == b
