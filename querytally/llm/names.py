"""Column names that a frame does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, base: str, *others: DataFrame) -> str:
    """``base``, or ``base`` with the first number that makes it new in all the frames, in any letter case."""
    taken = {c.lower() for frame in (df, *others) for c in frame.columns}
    names = [base, *(f"{base}_{i}" for i in range(len(taken) + 1))]
    return next(n for n in names if n.lower() not in taken)


def free_prefix(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with the first number that makes it the beginning of no column."""
    taken = [c.lower() for c in df.columns]
    names = [base, *(f"{base}{i}_" for i in range(len(taken) + 1))]
    return next(n for n in names if not any(c.startswith(n.lower()) for c in taken))
