"""Checks that stop a plan: a failing input raises with its keys before a sink has its rows.

A check is part of the plan. Its rows are judged in an aggregate, and the frame that goes on is joined to the verdict, so no row can be read or written without it. An empty
frame has no rows to hold back; only ``some`` judges it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Failing keys that a message names; all are counted.
NAMED = 5


def _stop(broken: Column, message: Column) -> Column:
    """True, or an error with the message."""
    return F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def _after(df: DataFrame, verdict: DataFrame) -> DataFrame:
    """df, once the one row of the verdict is known to hold."""
    return df.crossJoin(F.broadcast(verdict.select(F.col("_holds")))).where("_holds").drop("_holds")


def no_rows(df: DataFrame, offending: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, if ``offending`` has no row; else an error that counts its rows and names the least keys among them."""
    key = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    named = offending.select(key.alias("_key")).groupBy("_key").agg(F.count("*").alias("_n"))
    # the least few keys by partial top-k; counts over all
    few = named.orderBy("_key").limit(NAMED).agg(F.array_join(F.array_sort(F.collect_list("_key")), "; ").alias("_few"))
    total = named.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    both = total.crossJoin(F.broadcast(few))
    return _after(df, both.select(_stop(F.col("_n") > 0, F.concat(F.lit(f"{what}: "), F.col("_n").cast("string"), F.lit(" rows, "), F.col("_few"))).alias("_holds")))


def every(df: DataFrame, condition: Column, keys: list[str], what: str) -> DataFrame:
    """df, if the condition is true of all its rows (null is not true)."""
    return no_rows(df, df.where(~F.coalesce(condition, F.lit(False))), keys, what)


def unique(df: DataFrame, keys: list[str], what: str = "a key has several rows") -> DataFrame:
    """df, if no key stands twice."""
    return no_rows(df, df.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1"), keys, what)


def some(df: DataFrame, what: str, least: int = 1) -> DataFrame:
    """df, if it has as many rows."""
    verdict = df.agg(F.count("*").alias("_n")).select(_stop(F.col("_n") < least, F.concat(F.lit(f"{what}: "), F.col("_n").cast("string"), F.lit(f" rows of at least {least}"))).alias("_holds"))
    # an empty frame has no row that could wait for the verdict: it stands beside it as a branch of its own
    blank = verdict.where(~F.col("_holds")).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(blank)


def every_kind(df: DataFrame, checks: DataFrame, kinds: list[str], what: str = "a kind of check matched nothing") -> DataFrame:
    """df, if each kind stands in ``checks`` (a column kind) at least once: a check that never applies proves nothing."""
    met = checks.agg(F.collect_set("kind").alias("_met"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in kinds]), F.col("_met")))
    return _after(df, met.select(_stop(F.size(missing) > 0, F.concat(F.lit(f"{what}: "), F.array_join(missing, ", "))).alias("_holds")))


def newest_that_agree(df: DataFrame, cell: list[str], value: str, edition: str, overlaps: int = 1) -> DataFrame:
    """cell, value of the newest edition, n_editions; an error where editions differ on a cell, or where fewer than ``overlaps`` cells overlap."""
    got = df.groupBy(*cell).agg(F.max_by(value, edition).alias(value), F.countDistinct(edition).alias("n_editions"), (F.max(value) - F.min(value)).alias("_spread"))
    got = no_rows(got, got.where("_spread > 0"), cell, "editions differ")
    verdict = got.agg(F.count_if(F.col("n_editions") > 1).alias("_n")).select(_stop(F.col("_n") < overlaps, F.concat(F.lit("editions overlap on "), F.col("_n").cast("string"), F.lit(f" cells of at least {overlaps}"))).alias("_holds"))
    return _after(got, verdict).drop("_spread")


def cross_checked(df: DataFrame, other: DataFrame, keys: list[str], value: str, decimals: int, least: int) -> DataFrame:
    """df, if its values equal those of another table at so many decimals on every shared key, and enough keys are shared."""
    both = df.select(*keys, F.bround(value, decimals).alias("_a")).join(other.select(*keys, F.bround(value, decimals).alias("_b")), keys)
    df = no_rows(df, both.where("_a <> _b"), keys, "tables differ")
    verdict = both.agg(F.count("*").alias("_n")).select(_stop(F.col("_n") < least, F.concat(F.lit("tables share "), F.col("_n").cast("string"), F.lit(f" keys of at least {least}"))).alias("_holds"))
    return _after(df, verdict)
