"""Printed cells to a panel of units, years and indicators, with everything that was refused and why.

Labels are resolved against a table of names, columns are accepted only where they are the period of their row, printings of one cell are
pooled where they agree, and indicator-years are held against printed totals. Each step gives one frame with a status, so that kept and
refused rows come from the same pass, and kept with refused is what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Tolerances of sums against totals and of both sexes against the figure for both.
TOLERANCE, FLOOR = 0.02, 5.0
SEXES = 0.15


def folded_label(label: Column) -> Column:
    """A printed label without a number that leaked before it, accents, case, blanks and marks."""
    return T.fold(F.regexp_replace(label, r"^\d+\s+", ""))


def resolve(rows: DataFrame, names: DataFrame, label: str, unit: str, *, longest: bool = False) -> DataFrame:
    """Adds ``unit``, the name a label stands for; null where it is none. names (one column) is a dimension of fixed size.

    With ``longest`` a label may go on after the name: the longest name that it begins with counts. Labels meet names on
    equal keys in both cases: the prefixes of a label that are as long as some name.
    """
    key = folded_label(F.col(names.columns[0]))
    names = names.select(key.alias("_name"), F.col(names.columns[0]).alias(unit)).where("_name <> ''").dropDuplicates(["_name"])
    rows = rows.withColumn("_fold", F.coalesce(folded_label(F.col(label)), F.lit("")))
    if not longest:
        return rows.join(F.broadcast(names), F.col("_fold") == F.col("_name"), "left").drop("_fold", "_name")
    lengths = names.agg(F.collect_set(F.length("_name")).alias("_lengths"))  # one row
    labels = rows.select("_fold").distinct().crossJoin(F.broadcast(lengths))
    heads = labels.select("_fold", F.explode(F.filter("_lengths", lambda n: n <= F.length("_fold"))).alias("_n"))
    found = heads.join(F.broadcast(names), F.substring("_fold", F.lit(1), F.col("_n")) == F.col("_name")).groupBy("_fold").agg(F.max_by(unit, "_n").alias(unit))
    return rows.join(found, "_fold", "left").drop("_fold")


def is_period(column: Column, year: Column) -> Column:
    """Whether a column label is a bare year, or the school year that begins in the row's year ("2018/19", or printed end first "19-18")."""
    start = F.regexp_extract(column, r"^(\d{4})[/-]\d{2}$", 1).try_cast("int")
    end = F.regexp_extract(column, r"^(\d{2})-(\d{2})$", 2).try_cast("int")
    bare = column.rlike(r"^(19|20)\d\d$")
    return F.coalesce(bare | (start == year) | ((end + F.when(end > 50, 1900).otherwise(2000)) == year), F.lit(False))


def pool(rows: DataFrame, cell: list[str], more: list[str] = ()) -> DataFrame:
    """One row for each cell: value, n_editions, agreement, status. Where its printings differ the cell is disputed and has no value."""
    agrees = F.countDistinct("value") == 1
    n = F.sum("n_editions")
    agreement = F.when(F.bool_or(F.col("agreement") == "revised"), "revised").when(n > 1, "confirmed").otherwise("single source")
    return rows.groupBy(*cell).agg(
        F.when(agrees, F.min("value")).alias("value"), n.alias("n_editions"), F.when(agrees, agreement).alias("agreement"), F.when(agrees, "kept").otherwise("disputed").alias("status"), *[F.min(c).alias(c) for c in more]
    )


def against_totals(panel: DataFrame, printed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, summed, printed, gap, agrees: sums of the panel against printed totals, for the keys that have one."""
    summed = panel.groupBy(*keys).agg(F.sum("value").alias("summed"))
    gap = F.col("summed") - F.col("printed")
    ok = F.abs(gap) <= F.greatest(TOLERANCE * F.abs("printed"), F.lit(FLOOR))
    return summed.join(printed, keys).withColumns({"gap": gap, "agrees": ok})


def sexes(cells: DataFrame, keys: list[str], male: str, female: str, both: str) -> DataFrame:
    """The cells with ``gap`` and ``fits``: men and women against the figure for both, on the keys that have all three (else it fits)."""
    w = Window.partitionBy(*keys)
    of = lambda name: F.max(F.when(F.col("indicator") == name, F.col("value"))).over(w)
    gap = F.abs(of(male) + of(female) - of(both))
    return cells.withColumns({"gap": gap, "fits": F.coalesce(gap <= SEXES, F.lit(True))})


def boundary(panel: DataFrame, parent: str, child: str, latest: int) -> DataFrame:
    """Adds ``boundary`` to cells of the parent from before its child reported, and ``status`` gone to the child's own cells of that time."""
    first = F.min(F.when((F.col("unit") == child) & (F.col("value") > 0), F.col("year"))).over(Window.partitionBy("indicator"))
    before = F.coalesce(F.col("year") < F.when(first > latest, latest).otherwise(first), F.lit(False))
    return panel.withColumns({
        "boundary": F.when(before & (F.col("unit") == parent), F.lit(f"includes {child}, which was still part of {parent}")).otherwise(""),
        "status": F.when(before & (F.col("unit") == child), "gone").otherwise("kept"),
    })
