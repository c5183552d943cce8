"""Keys and checks of a schema, asked as questions about the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .joins import matching


def repeated_keys(df: DataFrame, key: list) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling_keys(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return matching(df.filter(F.col(key).isNotNull()), parent, key, parent_key, keep=False)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows per named check that break it; null does not break a check."""
    broken = [F.count_if(F.coalesce(~cond, F.lit(False))) for cond in checks.values()]
    counts = df.agg(F.array(*[F.struct(F.lit(n).alias("check"), b.alias("n")) for n, b in zip(checks, broken)]).alias("c"))
    return counts.select(F.inline("c"))
