"""PostgreSQL null ordering: nulls sort as the largest value."""

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pg_asc(c) -> Column:
    return _col(c).asc_nulls_last()


def pg_desc(c) -> Column:
    return _col(c).desc_nulls_first()
