"""Weighted distribution measures as column expressions, window sums and one aggregate.

Everything here is one shuffle on the group key: rows are ranked once inside their group (window sums
over the sorted group) and all measures of the group come from a single aggregate over that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Atkinson aversions, percentile pairs, tail size, published decimals.
EPSILONS = {"0_5": 0.5, "1": 1.0, "2": 2.0}
PAIRS = ((90, 10), (80, 20))
TAIL = 3
DECIMALS = 6


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w x over sum of w, over rows where x is known; null without weight."""
    known = F.when(x.isNotNull(), w)
    return F.try_divide(F.sum(known * x), F.sum(known))


def weighted_share(condition: Column, w: Column) -> Column:
    """Percentage of the weight that satisfies a condition."""
    return F.try_divide(100 * F.sum(F.when(condition, w).otherwise(0.0)), F.sum(w))


def publish(x: Column) -> Column:
    """The publication rule: six decimals, half to even; a negative zero is a zero."""
    return F.bround(x, DECIMALS) + F.lit(0.0)


def cents(x: str) -> Column:
    """Money as a decimal, whose sums do not depend on their order."""
    return F.col(x).cast("decimal(18,2)")


def mean_of_cents(total: Column, n: Column) -> Column:
    """An exact sum divided once."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def ranked(df: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    """Adds _n, _w (share of weight), _c (cumulative share), _mu to each row; rows without a value are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    group = Window.partitionBy(*keys)
    order = group.orderBy(value, *([weight] if weight else []))
    df = df.where(F.col(value).isNotNull() & w.isNotNull()).withColumn("_y", F.col(value).cast("double")).withColumn("_raw", w)
    df = df.withColumn("_w", F.try_divide(F.col("_raw"), F.sum("_raw").over(group)))
    return df.withColumns({
        "_n": F.count("*").over(group), "_c": F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_mu": F.sum(F.col("_w") * F.col("_y")).over(group), "_least": F.min("_y").over(group), "_k": F.row_number().over(order),
    })


#: Parts of a group's value range; a task ranks one part of one group.
PARTS = 64


def _in_parts(df: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    """Adds _part: the stretch of the group's values in which a row lies, by approximate quantiles. Equal values share a part, and parts ascend with values."""
    if parts < 2:
        return df.withColumn("_part", F.lit(0))
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000)
    edges = df.groupBy(*keys).agg(cuts.alias("_edges"))
    return df.join(F.broadcast(edges), keys).withColumn("_part", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")


def _before(df: DataFrame, keys: list[str], total: dict[str, Column]) -> DataFrame:
    """df with, for each total by name: its sum over the parts before (before_<name>) and over the group (all_<name>); one row a part is summed up."""
    group = Window.partitionBy(*keys)
    per = df.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in total.items()])
    running = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum(n).over(running), F.lit(0)).alias(f"before_{n}") for n in total] + [F.sum(n).over(group).alias(f"all_{n}") for n in total]
    return df.join(F.broadcast(per.select(*keys, "_part", *columns)), [*keys, "_part"])


def tiles(df: DataFrame, keys: list[str], n: int, value: str, tie: str, out: str, parts: int = PARTS) -> DataFrame:
    """Adds ``out``: the n-tile of each row in the order of (value, tie) in its group, as ntile gives it, without a task that holds a group.

    Ranks are exact: rows before a part are counted, and a row's place in its part is its row number there. Rows without a value are left out.
    """
    df = _before(_in_parts(df.where(F.col(value).isNotNull()), keys, value, parts), keys, {"rows": F.count("*")})
    at = F.col("before_rows") + F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(value, tie)) - 1
    low, longer = F.floor(F.col("all_rows") / n), F.col("all_rows") % n
    tile = F.when(at < longer * (low + 1), F.floor(at / (low + 1))).otherwise(longer + F.floor((at - longer * (low + 1)) / F.greatest(low, F.lit(1))))
    return df.withColumn(out, (tile + 1).cast("int")).drop("_part", "before_rows", "all_rows")


def split_gini(df: DataFrame, keys: list[str], value: str, weight: str, parts: int = PARTS) -> DataFrame:
    """keys, n and gini (0 to 1) of weighted microdata: equal values are summed first, then ranked in parts, so neither a group nor a frequent value is one task's work."""
    known = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    sums = known.groupBy(*keys, F.col(value).cast("double").alias("_y")).agg(F.sum(F.col(weight).cast("double")).alias("_w"), F.count("*").alias("_m"))
    sums = _before(_in_parts(sums, keys, "_y", parts), keys, {"w": F.sum("_w"), "wy": F.sum(F.col("_w") * F.col("_y")), "m": F.sum("_m")})
    upto = F.col("before_w") + F.sum("_w").over(Window.partitionBy(*keys, "_part").orderBy("_y").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumns({"_mid": F.try_divide(upto - F.col("_w") / 2, F.col("all_w")), "_share": F.try_divide("_w", "all_w"), "_mu": F.try_divide("all_wy", "all_w")})
    ok = (F.max("all_m") >= 2) & (F.max("_mu") > 0)
    gini = F.try_divide(F.lit(2.0), F.max("_mu")) * F.sum(F.col("_share") * F.col("_y") * (F.col("_mid") - 0.5))
    return sums.groupBy(*keys).agg(F.max("all_m").alias("n"), F.when(ok, gini).alias("gini"))


def gini_of_ranked() -> Column:
    """2/mu * sum w y (mid-rank - 1/2); equals the double sum over all pairs, ties and weights included."""
    mid = F.col("_c") - F.col("_w") / 2
    ok = (F.max("_n") >= 2) & (F.max("_mu") > 0)
    return F.when(ok, F.try_divide(F.lit(2.0), F.max("_mu")) * F.sum(F.col("_w") * F.col("_y") * (mid - 0.5)))


def _positive(expr: Column) -> Column:
    return F.when((F.max("_n") >= 2) & (F.min("_least") > 0), expr)


def theil_t() -> Column:
    x = F.when(F.col("_least") > 0, F.col("_y") / F.col("_mu"))
    return _positive(F.sum(F.col("_w") * x * F.log(x)))


def theil_l() -> Column:
    return _positive(F.sum(F.col("_w") * F.log(F.when(F.col("_least") > 0, F.col("_mu") / F.col("_y")))))


def atkinson(e: float) -> Column:
    y = F.when(F.col("_least") > 0, F.col("_y"))
    if e == 1.0:
        return _positive(1 - F.try_divide(F.exp(F.sum(F.col("_w") * F.log(y))), F.max("_mu")))
    return _positive(1 - F.try_divide(F.pow(F.sum(F.col("_w") * F.pow(y, F.lit(1 - e))), F.lit(1 / (1 - e))), F.max("_mu")))


def variation() -> Column:
    spread = F.sum(F.col("_w") * F.pow(F.col("_y") - F.col("_mu"), F.lit(2)))
    return F.when((F.max("_n") >= 2) & (F.max("_mu") > 0), F.sqrt(spread) / F.max("_mu"))


def step_percentile(q: int) -> Column:
    """The first unit whose cumulative share reaches q percent; never between units."""
    reach = F.min(F.when(F.bround(F.col("_c"), 12) >= q / 100, F.col("_y")))
    return F.coalesce(reach, F.max("_y"))


def percentile_ratio(top: int, bottom: int) -> Column:
    low = step_percentile(bottom)
    return F.when((F.max("_n") >= 2) & (low > 0), F.try_divide(step_percentile(top), low))


def tail_ratio(k: int = TAIL) -> Column:
    """Mean of the k largest over the mean of the k smallest units."""
    low = F.avg(F.when(F.col("_k") <= k, F.col("_y")))
    high = F.avg(F.when(F.col("_k") > F.col("_n") - k, F.col("_y")))
    return F.when((F.max("_n") >= 2 * k) & (low > 0), F.try_divide(high, low))


def index_family(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row for each group with every index; null where an index is not defined."""
    out = {"n": F.max("_n").cast("bigint"), "mean": publish(F.bround(F.max("_mu"), 8)), "gini": publish(gini_of_ranked()), "theil_t": publish(theil_t()), "theil_l": publish(theil_l()), "cv": publish(variation())}
    out |= {f"atkinson_{k}": publish(atkinson(e)) for k, e in EPSILONS.items()}
    out |= {f"p{a}_p{b}": publish(percentile_ratio(a, b)) for a, b in PAIRS}
    return ranked(df, keys, value, weight).groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """Quantiles interpolated on cumulative-weight midpoints, clamped at both ends: keys, q, quantile."""
    order = Window.partitionBy(*keys).orderBy(value, weight)
    r = ranked(df, keys, value, weight).withColumn("_m", F.col("_c") - F.col("_w") / 2)
    r = r.withColumns({"_m2": F.lead("_m").over(order), "_y2": F.lead("_y").over(order), "_m0": F.lag("_m").over(order)})
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles]))
    r = r.select(*keys, "_m", "_y", "_m2", "_y2", "_m0", q.alias("q"))
    inside = (F.col("q") >= F.col("_m")) & (F.col("q") < F.col("_m2"))
    at = F.when(inside, F.col("_y") + F.try_divide((F.col("q") - F.col("_m")) * (F.col("_y2") - F.col("_y")), F.col("_m2") - F.col("_m")))
    low = F.when(F.col("_m0").isNull() & (F.col("q") < F.col("_m")), F.col("_y"))
    high = F.when(F.col("_m2").isNull() & (F.col("q") >= F.col("_m")), F.col("_y"))
    return r.withColumn("x", F.coalesce(at, low, high)).groupBy(*keys, "q").agg(publish(F.max("x")).alias("quantile"))


def lorenz(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Points of the Lorenz curve with the origin: keys, k, population, share."""
    order = Window.partitionBy(*keys).orderBy(value, *([weight] if weight else [])).rowsBetween(Window.unboundedPreceding, 0)
    r = ranked(df, keys, value, weight).withColumn("share", F.try_divide(F.sum(F.col("_w") * F.col("_y")).over(order), F.col("_mu")))
    point = F.struct(F.col("_k").cast("bigint").alias("k"), publish(F.col("_c")).alias("population"), publish(F.col("share")).alias("share"))
    origin = F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("population"), F.lit(0.0).alias("share"))
    # the first point of a group brings the origin with it
    return r.select(*keys, F.explode(F.when(F.col("_k") == 1, F.array(origin, point)).otherwise(F.array(point))).alias("p")).select(*keys, "p.*")


def least_served(df: DataFrame, keys: list[str], value: str, weight: str | None = None, at: float = 0.5) -> DataFrame:
    """The share that the lower part (half) of the population holds, interpolated on the Lorenz curve."""
    w = Window.partitionBy(*keys).orderBy("k")
    p = lorenz(df, keys, value, weight).withColumns({"p2": F.lead("population").over(w), "s2": F.lead("share").over(w)})
    hit = p.where((F.col("population") <= at) & (F.col("p2") > at))
    inside = F.col("share") + F.try_divide((F.lit(at) - F.col("population")) * (F.col("s2") - F.col("share")), F.col("p2") - F.col("population"))
    return hit.select(*keys, publish(inside).alias("lower_share"))


def theil_split(df: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Theil-T within and between parts (unweighted units); null where a unit is not positive.

    Two aggregates on one shuffle key chain: units to parts, parts to groups.
    """
    y = F.col(value).cast("double")
    parts = df.groupBy(*keys, part).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.when(y > 0, y * F.log(y))).alias("ylny"), F.min(y).alias("least"))
    total, n = F.sum("s"), F.sum("n")
    mu = total / n
    ok = F.min("least") > 0
    theil = F.sum("ylny") / total - F.log(mu)
    between = F.sum(F.when(F.col("s") > 0, F.col("s") * F.log(F.col("s") / F.col("n")))) / total - F.log(mu)
    within = F.sum(F.when(F.col("s") > 0, F.col("ylny") - F.col("s") * F.log(F.col("s") / F.col("n")))) / total
    return parts.groupBy(*keys).agg(
        n.cast("bigint").alias("units"), publish(F.when(ok, theil)).alias("theil"), publish(F.when(ok, between)).alias("theil_between"),
        publish(F.when(ok, within)).alias("theil_within"), publish(F.when(ok, F.try_divide(between, theil))).alias("between_share"),
        F.coalesce(F.abs(theil - between - within) <= 1e-9, F.lit(True)).alias("identity_holds"),
    )
