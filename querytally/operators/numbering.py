"""Row numbers over any amount of rows, also inside one very large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordering import _col, pg_asc
from ..session import written

_AT = "__at"
_SLICE = "__slice"
_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def _sorted_slices(df: DataFrame, order) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with a fixed position.

    The position is written out before it is used: counting and numbering read
    the same slices even if a task is run again with other range bounds.
    """
    order = [pg_asc(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_AT, F.monotonically_increasing_id())
    )
    return written(placed).withColumn(_SLICE, F.shiftright(_AT, _SHIFT))


def number_rows(df: DataFrame, order_by, name="n", start=1) -> DataFrame:
    """Consecutive numbers over the whole frame in ``order_by`` order.

    One range shuffle; only one (slice, count) row per partition meets in the
    single-task window, so its size follows the partition count, not the data.
    ``order_by`` should end in a unique key.
    """
    placed = _sorted_slices(df, order_by)
    sizes = placed.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(_SLICE, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.col(_AT) - F.shiftleft(_SLICE, _SHIFT)
    return (
        placed.join(F.broadcast(offsets), _SLICE)
        .withColumn(name, F.col("__before") + inside + F.lit(start))
        .drop(_SLICE, _AT, "__before")
    )


def number_within(df: DataFrame, group_by, order_by, name="n", start=1) -> DataFrame:
    """Row numbers per group where a single group may exceed any task.

    A large group spreads over many range slices; the join back is on
    (slice, group), so no key of it collects more than one slice.
    """
    group_by = list(group_by)
    placed = _sorted_slices(df, [*group_by, *order_by])
    pieces = placed.groupBy(_SLICE, *group_by).agg(
        F.count(F.lit(1)).alias("__size"), F.min(_AT).alias("__first")
    )
    earlier = W.partitionBy(*group_by).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col(_SLICE).alias("__s"),
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group_by)],
        (F.coalesce(F.sum("__size").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col(_SLICE) == F.col("__s")
    for i, g in enumerate(group_by):
        same = same & _col(g).eqNullSafe(F.col(f"__g{i}"))
    return (
        placed.join(offsets, same)
        .withColumn(name, F.col(_AT) + F.col("__shift") + F.lit(start))
        .drop(_SLICE, _AT, "__s", "__shift", *[f"__g{i}" for i in range(len(group_by))])
    )


def padded_names(numbered: DataFrame, number="n", name="name") -> DataFrame:
    """Zero-padded text of a number column, as wide as the largest number."""
    width = numbered.agg(F.length(F.max(number).cast("string"))).scalar()
    return numbered.withColumn(
        name, F.lpad(F.col(number).cast("string"), F.coalesce(width, F.lit(1)), F.lit("0"))
    )
