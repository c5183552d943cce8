"""Arithmetic with the corpus' meaning: integer division, safe ratios, shares."""

from pyspark.sql import Column, functions as F

from .ordering import _col


def int_div(a, b) -> Column:
    """Quotient of two integers, cut towards zero; an error when ``b`` is 0."""
    return F.call_function("div", _col(a), _col(b))


def safe_ratio(a, b) -> Column:
    """a / b as double, null where b is zero."""
    return _col(a).cast("double") / F.nullif(_col(b).cast("double"), F.lit(0.0))


def count_where(cond: Column) -> Column:
    """COUNT(*) FILTER (WHERE cond)."""
    return F.count_if(cond)


def sum_where(cond: Column, value=1) -> Column:
    """SUM(CASE WHEN cond THEN value ELSE 0 END)."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def percent_where(cond: Column, digits=2) -> Column:
    """Share of rows where ``cond`` holds, as a percentage; null on no rows."""
    return F.round(100.0 * safe_ratio(sum_where(cond), F.count(F.lit(1))), digits)


def pass_ratio(passing, total, empty=1.0) -> Column:
    """passing / total to two digits, half to even; ``empty`` when total is 0."""
    p, t = _col(passing), _col(total)
    return F.when(t == 0, F.lit(empty)).otherwise(F.bround(safe_ratio(p, t), 2))
