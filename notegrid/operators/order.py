"""Sorting, limits and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions.values import natural_key


def by_locale(c: Column) -> Column:
    """Names in the order of their language: letters before accents before case."""
    return F.collate(c, "UNICODE")


def loosely(c: Column) -> Column:
    """Texts that differ only in accents or case are equal; digit runs count as numbers."""
    return F.collate(natural_key(c), "UNICODE_CI_AI")


def sort_keys(df: DataFrame, field: str, desc: bool = False) -> list[Column]:
    """Missing values last in both directions, then the value, then the name."""
    kind = df.schema[field].dataType.simpleString()
    c = F.col(field)
    if kind.startswith("array"):
        c = F.array_join(c.cast("array<string>"), ", ")
        kind = "string"
    missing = c.isNull() | (c == "") if kind == "string" else c.isNull()
    key = F.when(~missing, loosely(c) if kind == "string" else c)  # all missing values are alike
    return [missing.asc(), key.desc() if desc else key.asc(), by_locale(F.col("name")).asc(), F.col("name").asc()]


def sort_rows(df: DataFrame, field: str | None = None, desc: bool = False) -> DataFrame:
    return df.orderBy(by_locale(F.col("name")), "name") if field is None else df.orderBy(*sort_keys(df, field, desc))


def limit_rows(df: DataFrame, n: int, field: str | None = None, desc: bool = False) -> DataFrame:
    if n < 1:
        raise ValueError("limit must be a positive whole number")
    return sort_rows(df, field, desc).limit(n)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("matched"))


def recent_rows(df: DataFrame, n: int = 20, mtime: str = "mtime") -> DataFrame:
    return df.orderBy(F.col(mtime).desc(), F.col("path").asc()).limit(n)


def sort_calendar(df: DataFrame, calendar: str, linear: str, desc: bool = False) -> DataFrame:
    """Dates of different calendars do not compare, so each calendar sorts on its own."""
    key = F.col(linear).desc() if desc else F.col(linear).asc()
    return df.orderBy(F.col(linear).isNull().asc(), F.col(calendar).asc(), key,
                      F.col("name").asc())


def query_receipt(df: DataFrame, settings: dict[str, str], limit: int | None = None) -> DataFrame:
    """One record per query: what was asked, how many matched and how many come back."""
    returned = F.col("matched") if limit is None else F.least("matched", F.lit(limit))
    return count_rows(df).select(
        *[F.lit(v).alias(k) for k, v in settings.items()], "matched",
        returned.cast("bigint").alias("returned"),
        (F.col("matched") > returned).alias("truncated"))
