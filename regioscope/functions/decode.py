"""Code books: decoding, classification and safe casts of coded microdata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_map(codes: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])


def decode(x: Column, codes: dict) -> Column:
    """Label of a code; an unmapped code (such as "not declared") is null."""
    return code_map(codes)[x]


def decode_frame(df: DataFrame, books: dict[str, dict]) -> DataFrame:
    """Decodes every column that has a code book, in one projection."""
    return df.withColumns({c: decode(F.col(c), b) for c, b in books.items() if c in df.columns})


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def number(x: Column) -> Column:
    """Numeric or null; never raises."""
    return x.try_cast("double")


def classify(code: Column, overrides: dict[int, int]) -> Column:
    """Main group of a product code: hundreds of a short code, thousands of a long one, with exceptions."""
    group = F.when(code < 1000, F.floor(code / 100)).otherwise(F.floor(code / 1000)).cast("int")
    return F.coalesce(code_map(overrides)[code.cast("int")], group) if overrides else group


def without_sentinels(df: DataFrame, column: str, sentinels: tuple[int, ...] = (9, 99, 999, 9999, 99999, 999999)) -> DataFrame:
    """Rows whose value is a real one; an error if none is left."""
    kept = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*sentinels))
    if kept.isEmpty():
        raise ValueError(f"{column}: nothing is left without sentinels")
    return kept


def lead_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The given columns first, the others in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])
