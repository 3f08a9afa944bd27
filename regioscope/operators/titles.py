"""Titles that name one table in several editions: prefix candidates confirmed on shared cells, merged transitively."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Shared cells that confirm a pair, their least agreement, the ratio of two equal printings.
SHARED, AGREEMENT, RATIO = 5, 0.95, 1.10


def canonical(df: DataFrame, cell: list[str], chapter: str = "chapter", title: str = "title", value: str = "value") -> DataFrame:
    """chapter, title, canonical: pairs meet only on cells they share, so no pair is made that cannot be confirmed."""
    one = df.groupBy(chapter, title, *cell).agg(F.max(value).alias("v")).withColumn("stem", T.stem(F.col(title)))
    a, b = one.alias("a"), one.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [chapter, *cell]]
    related = F.col("a.stem").startswith(F.col("b.stem")) | F.col("b.stem").startswith(F.col("a.stem"))
    pairs = a.join(b, same).where((F.col(f"a.{title}") < F.col(f"b.{title}")) & related)
    big, small = F.greatest(F.abs("a.v"), F.abs("b.v")), F.least(F.abs("a.v"), F.abs("b.v"))
    agrees = F.try_divide(big, F.greatest(small, F.lit(1e-9))) <= RATIO
    edges = pairs.groupBy(F.col(f"a.{chapter}").alias("c"), F.col(f"a.{title}").alias("s"), F.col(f"b.{title}").alias("t")).agg(F.count("*").alias("n"), F.avg(agrees.cast("double")).alias("ok")).where((F.col("n") >= SHARED) & (F.col("ok") >= AGREEMENT))
    both = edges.select("c", "s", "t").union(edges.select("c", "t", "s"))
    label = one.select(F.col(chapter).alias("c"), F.col(title).alias("s")).distinct().withColumn("root", F.col("s"))
    # a few hundred titles: least labels spread until nothing changes, however long a chain is
    both, label = both.cache(), label.cache()
    while True:
        step = both.join(label.select("c", F.col("s").alias("t"), "root"), ["c", "t"]).groupBy("c", "s").agg(F.min("root").alias("low"))
        new = label.join(step, ["c", "s"], "left").select("c", "s", F.least("root", F.coalesce("low", "root")).alias("root")).cache()
        moved = new.join(label.withColumnRenamed("root", "was"), ["c", "s"]).where("root <> was").limit(1).count()
        label.unpersist()
        label = new
        if not moved:
            break
    accents = F.length(F.regexp_replace("s", "[\\x00-\\x7F]", ""))
    best = F.first("s").over(Window.partitionBy("c", "root").orderBy(F.desc(F.length(T.stem(F.col("s")))), F.desc(accents), "s"))
    return label.select(F.col("c").alias(chapter), F.col("s").alias(title), best.alias("canonical"))
