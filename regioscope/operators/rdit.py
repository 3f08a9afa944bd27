"""Regression discontinuity in time.

The local-linear estimate, its Newey-West error and the worst-case bias are window sums and one
aggregate: a fully interacted line separates by side, so closed-form sums do. Only small dense
problems (seasonal dummies, global polynomials, bandwidth choice, permutations) run in pandas, on one
series of at most a few hundred periods at a time.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest lag, seed and number of permutation draws, polynomial degree, level.
LAGS = 12
SEED, DRAWS = 20110114, 20_000
DEGREE, ALPHA = 4, 0.05
FEW_POINTS, FEW_WEIGHTED, FEW_FREEDOM = 6, 6, 5


def grid(df: DataFrame, bandwidths: list[int], donuts: list[int]) -> DataFrame:
    """Every row with each (bandwidth, donut) whose window holds it: the windows are cut before any shuffle."""
    pairs = F.array(*[F.struct(F.lit(h).alias("bandwidth"), F.lit(d).alias("donut")) for h in bandwidths for d in donuts])
    r = F.abs("running")
    return df.withColumn("g", F.explode(F.filter(pairs, lambda p: (r <= p["bandwidth"]) & (r >= p["donut"])))).select("*", "g.bandwidth", "g.donut").drop("g")


def local_linear(df: DataFrame, keys: list[str], y: str, smoothness: Column | None = None) -> DataFrame:
    """tau, HAC se, counts, worst-case bias and a refusal reason for each key, over rows in its window.

    df has ``running`` and ``bandwidth``; keys include the bandwidth. Triangular kernel.
    """
    df = df.where(F.col(y).isNotNull() & ~F.isnan(y))
    r, v = F.col("running").cast("double"), F.col(y)
    df = df.withColumns({"_r": r, "_k": F.greatest(1 - F.abs(r) / F.col("bandwidth"), F.lit(0.0)), "_right": r >= 0})
    side = Window.partitionBy(*keys, "_right")
    k, x = F.col("_k"), F.col("_r")
    s = {"_s0": F.sum(k), "_s1": F.sum(k * x), "_s2": F.sum(k * x * x), "_t0": F.sum(k * v), "_t1": F.sum(k * x * v)}
    df = df.withColumns({n: c.over(side) for n, c in s.items()})
    df = df.withColumn("_d", F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1"))
    df = df.withColumn("_d", F.when(F.col("_d") > 1e-9 * F.col("_s0") * F.col("_s2"), F.col("_d")))
    a = (F.col("_t0") * F.col("_s2") - F.col("_t1") * F.col("_s1")) / F.col("_d")
    b = (F.col("_s0") * F.col("_t1") - F.col("_s1") * F.col("_t0")) / F.col("_d")
    influence = k * (F.col("_s2") - F.col("_s1") * x) / F.col("_d") * F.when(F.col("_right"), 1.0).otherwise(-1.0)
    df = df.withColumn("_w", influence).withColumn("_psi", F.col("_w") * (v - a - b * x))
    line = Window.partitionBy(*keys).orderBy("_r")
    df = df.withColumns({f"_p{i}": F.col("_psi") * F.lag("_psi", i).over(line) for i in range(1, LAGS + 1)})
    n, eff = F.count("*"), F.count_if(k > 0)
    lags = F.least(F.lit(LAGS), F.greatest(F.floor(n / 4).cast("int"), F.lit(1)))
    variance = F.sum(F.col("_psi") * F.col("_psi"))
    for i in range(1, LAGS + 1):
        variance = variance + F.when(lags >= i, 2 * (1 - F.lit(float(i)) / (lags + 1)) * F.coalesce(F.sum(f"_p{i}"), F.lit(0.0))).otherwise(0.0)
    flat = F.max(F.col("_d").isNull()) | (F.countDistinct("_right") < 2)
    refused = (
        F.when(n < FEW_POINTS, "too few observations").when(eff <= FEW_WEIGHTED, "too few weighted observations")
        .when(flat, "rank-deficient design").when(eff - 4 < FEW_FREEDOM, "too few residual degrees of freedom")
    )
    ok = refused.isNull()
    out = df.groupBy(*keys).agg(
        F.when(ok, F.sum(F.col("_w") * v)).alias("tau"), F.when(ok, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("se"),
        F.count_if(x < 0).cast("int").alias("n_left"), F.count_if(x >= 0).cast("int").alias("n_right"),
        F.when(ok, F.sum(F.abs("_w") * x * x) / 2).alias("bias_per_m"), refused.alias("refused"),
    )
    return out if smoothness is None else out.withColumn("worst_case_bias", F.col("bias_per_m") * smoothness)


def normal_cdf(x):
    """Of a number or an array."""
    return 0.5 * (1 + np.asarray(np.frompyfunc(math.erf, 1, 1)(np.asarray(x, float) / math.sqrt(2)), float))


def critical_value(ratio, alpha: float = ALPHA):
    """The 1 - alpha quantile of |N(ratio, 1)|, by bisection of all ratios at once; nan where a ratio is."""
    ratio = np.asarray(ratio, float)
    lo, hi = np.zeros_like(ratio), np.full_like(ratio, 50.0)
    for _ in range(50):
        mid = (lo + hi) / 2
        low = normal_cdf(mid - ratio) - normal_cdf(-mid - ratio) < 1 - alpha
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where(np.isnan(ratio), np.nan, hi)


def honest(df: DataFrame) -> DataFrame:
    """Bias-aware interval from tau, se and worst_case_bias; a zero error gives no interval."""

    @F.pandas_udf("double")
    def quantile(ratio: pd.Series) -> pd.Series:
        return pd.Series(critical_value(ratio.to_numpy(float))).replace({np.nan: None}).astype(float)

    cv = quantile(F.try_divide("worst_case_bias", "se"))
    half = F.when(F.col("se") > 0, cv * F.col("se"))
    df = df.withColumns({"honest_lo": F.col("tau") - half, "honest_hi": F.col("tau") + half})
    return df.withColumns({"honest_excludes_zero": (F.col("honest_lo") > 0) | (F.col("honest_hi") < 0), "bias_exceeds_estimate": F.col("worst_case_bias") > F.abs("tau")})


def smoothness(running: np.ndarray, y: np.ndarray, degree: int = DEGREE) -> float:
    """Largest curvature of a global polynomial on 400 points."""
    good = np.isfinite(y)
    scale = np.abs(running[good]).max()
    p = np.polynomial.Polynomial.fit(running[good] / scale, y[good], degree, domain=[-1, 1])
    z = running[good] / scale
    return float(np.abs(p.deriv(2)(np.linspace(z.min(), z.max(), 400))).max() / scale**2)


def deseasonalise(running: np.ndarray, y: np.ndarray, month: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Takes out month effects estimated beside a trend that may bend and jump at the cutoff."""
    z = running / np.abs(running).max()
    right = (running >= 0).astype(float)
    trend = np.vander(z, degree + 1, increasing=True)
    dummies = (month[:, None] == np.unique(month)[None, 1:]).astype(float)
    beta, *_ = np.linalg.lstsq(np.hstack((trend, trend * right[:, None], dummies)), y, rcond=None)
    return y - dummies @ beta[2 * (degree + 1) :]


def cross_validated_bandwidth(running: np.ndarray, y: np.ndarray, candidates, edge: float = 0.5) -> float:
    """The bandwidth of the least leave-one-out error of one-sided lines, scored near the cutoff."""
    gap = running[None, :] - running[:, None]
    same = (running[None, :] >= 0) == (running[:, None] >= 0)
    usable = same & np.isfinite(y)[None, :] & ~np.eye(len(y), dtype=bool)
    scored = np.isfinite(y) & (np.abs(running) <= edge * np.abs(running).max())
    clean = np.nan_to_num(y)
    best, least = candidates[0], math.inf
    for h in candidates:
        near = usable & (np.abs(gap) <= h)
        k = np.where(near, np.clip(1 - np.abs(gap) / h, 0, None), 0.0)
        s0, s1, s2 = k.sum(1), (k * gap).sum(1), (k * gap * gap).sum(1)
        t0, t1 = k @ clean, (k * gap) @ clean
        det = s0 * s2 - s1 * s1
        # a flat design has the least-norm solution: its mean, or the line through the origin of one point
        line = np.where(det > 1e-10 * np.maximum(s0 * s2, 1e-300), (s2 * t0 - s1 * t1) / np.where(det == 0, 1, det), t0 * s0 / np.maximum(s0 * s0 + s1 * s1, 1e-300))
        use = scored & (near.sum(1) >= 3)
        score = ((clean - line)[use] ** 2).mean() if use.any() else math.inf
        if score < least:
            best, least = h, score
    return float(best)


def permutation(running: np.ndarray, y: np.ndarray, window: float) -> tuple[float | None, int, float | None, str | None]:
    """(p, periods, least possible p, refusal) of the difference of period means."""
    on = (np.abs(running) <= window) & np.isfinite(y)
    periods, back = np.unique(running[on], return_inverse=True)
    n, k = len(periods), int((periods >= 0).sum())
    if min(k, n - k) < 2:
        return None, n, None, "under two periods on a side"
    mean = np.bincount(back, y[on]) / np.bincount(back)
    total = math.comb(n, k)
    floor = min(1.0, (2 if 2 * k == n else 1) / total)
    seen = abs(mean[periods >= 0].mean() - mean[periods < 0].mean())
    if total <= DRAWS:
        picked = np.array(list(itertools.combinations(range(n), k)))
    else:
        rng = np.random.default_rng(SEED)  # one generator for each test, so tests do not depend on their order
        picked = np.stack([rng.choice(n, k, replace=False) for _ in range(DRAWS)])
    inside = mean[picked].sum(1)
    hits = int((np.abs(inside / k - (mean.sum() - inside) / (n - k)) >= seen - 1e-12).sum())
    return (hits / total if total <= DRAWS else (hits + 1) / (DRAWS + 1)), n, floor, None
