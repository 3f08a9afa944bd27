"""Modules of one survey brought together: joins on several keys with columns that collide, labels with their origin, labels repaired within their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import guard

#: Numbers that may have leaked before a label, and the label of a code that a book does not have.
MOST_LEAKED = 4
UNMAPPED = "— (mapped to missing)"


def joined(left: DataFrame, right: DataFrame, keys: list[str], drop: tuple[str, ...] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """left with the columns of right, on all keys, every row of left once.

    A column that both have is dropped from right or renamed where that is asked for; else it has to say the same: it is kept once, filled
    from right where left does not know it, and the plan stops where two known values differ, or where right has a key twice. Null keys match nothing.
    """
    right = right.drop(*drop).withColumnsRenamed(rename or {})
    right = guard.unique(right, keys, "the joined module has a key twice")
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    right = right.withColumnsRenamed({c: f"{c}__right" for c in shared})
    out = left.join(right, keys, "left")

    def same(c: str):
        """Judged where the row is made, so that nothing is read twice."""
        at = F.concat_ws(" | ", *[F.col(k).cast("string") for k in keys])
        differ = F.coalesce(F.col(c) != F.col(f"{c}__right"), F.lit(False))
        return F.when(differ, F.raise_error(F.concat(F.lit(f"the modules differ on {c}: "), at)).cast(left.schema[c].dataType)).otherwise(F.coalesce(c, f"{c}__right")).alias(c)

    return out.select(*[same(c) if c in shared else c for c in left.columns], *[c for c in right.columns if c not in keys and not c.endswith("__right")])


def label_index(books: DataFrame, other: DataFrame, columns: DataFrame) -> DataFrame:
    """column, code, origin, label, other_label, conflict: the union of two books' codes for every column that has a book.

    books: column, origin (order of the files), code, label; other: column, code, label; columns: the columns that are wanted. The first
    file that has a column is its origin and gives its labels; conflict tells that another file gives a code another label. A code that one of the books
    lacks has an empty label there, or says that it is mapped to missing.
    """
    books = books.join(columns, "column", "left_semi")
    first = Window.partitionBy("column")
    per = books.groupBy("column", "code", "origin").agg(F.min("label").alias("label"))
    per = per.withColumns({"first": F.min("origin").over(first), "kinds": F.size(F.collect_set("label").over(Window.partitionBy("column", "code")))})
    codes = per.groupBy("column", "code").agg(F.max(F.when(F.col("origin") == F.col("first"), F.col("label"))).alias("label"), F.min("first").alias("first"), (F.max("kinds") > 1).alias("conflict"))
    codes = codes.where("label is not null or conflict")  # codes of later files alone are not the column's
    other = other.join(columns, "column", "left_semi").groupBy("column", "code").agg(F.min("label").alias("other_label"))
    origin = per.groupBy("column").agg(F.min("first").alias("origin"))
    out = codes.drop("first").join(other, ["column", "code"], "full").join(F.broadcast(origin), "column", "left")
    return out.select("column", "code", "origin", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("other_label", F.lit(UNMAPPED)).alias("other_label"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def rejoined(df: DataFrame, table: list[str], label: str) -> DataFrame:
    """Adds ``rejoined`` and ``repair``: numbers that leaked before a label are taken off where what is left is a label of the same table.

    repair is untouched, repaired or refused. The fewest numbers that lead to a known label count; up to ``MOST_LEAKED`` stand one behind another.
    """
    stray = r"^(?:\d+\s{2,})"
    leaks = F.col(label).rlike(stray)
    known = df.where(~leaks).select(*table, F.col(label).alias("_known")).distinct()
    labels = df.where(leaks).select(*table, F.col(label).alias("_label")).distinct()
    tries = labels.select(*table, "_label", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.regexp_replace("_label", rf"{stray}{{{i}}}", "").alias("rest")) for i in range(1, MOST_LEAKED + 1)])).alias("t"))
    tries = tries.select(*table, "_label", "t.n", F.col("t.rest").alias("_known")).where("_known <> _label")
    found = tries.join(known, [*table, "_known"]).groupBy(*table, "_label").agg(F.min_by("_known", "n").alias("_found"))
    out = df.join(found.withColumnRenamed("_label", label), [*table, label], "left")
    repair = F.when(F.col("_found").isNotNull(), "repaired").when(leaks, "refused").otherwise("untouched")
    return out.select(*df.columns, F.coalesce("_found", label).alias("rejoined"), repair.alias("repair"))
