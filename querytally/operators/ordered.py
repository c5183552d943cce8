"""Order-dependent state over groups of any size.

A group is cut into chunks by its integer position column. Inside a chunk a
window does the work; one summary row per chunk carries the state on. The
summaries of a group are cut into spans of chunks in turn, and only one row per
span meets in one task: a group of 10**12 rows has a few thousand of them. So a
single group may hold most of the data without ever meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import int_div

CHUNK = "__chunk"
_SPAN, _SPAN_CHUNKS = "__span", 4096


def chunked(df: DataFrame, order: str, chunk_rows=65536) -> DataFrame:
    """Add the chunk column. Steps over the same chunks share one shuffle."""
    return df.withColumn(CHUNK, int_div(order, F.lit(chunk_rows)))


def running_sum(rows: DataFrame, group: list, order: str, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the group's rows up to and with the current one.

    ``rows`` is chunked and stays so.
    """
    rows = rows.withColumn("__value", value)
    inside = W.partitionBy(*group, CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(*group, CHUNK).agg(F.sum("__value").alias("__total")).withColumn(_SPAN, int_div(CHUNK, F.lit(_SPAN_CHUNKS)))
    in_span = W.partitionBy(*group, _SPAN).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    spans_before = W.partitionBy(*group).orderBy(_SPAN).rowsBetween(W.unboundedPreceding, -1)
    spans = totals.groupBy(*group, _SPAN).agg(F.sum("__total").alias("__span_total")).withColumn(
        "__spans", F.sum("__span_total").over(spans_before)).drop("__span_total")
    totals = (
        totals.withColumn("__chunks", F.sum("__total").over(in_span)).join(spans, [*group, _SPAN])
        .withColumn("__before", F.coalesce("__chunks", F.lit(0)) + F.coalesce("__spans", F.lit(0)))
        .drop("__total", "__chunks", "__spans", _SPAN)
    )
    return (
        rows.withColumn("__inside", F.sum("__value").over(inside))
        .join(totals, [*group, CHUNK])
        .withColumn(name, F.col("__inside") + F.col("__before"))
        .drop("__value", "__inside", "__before")
    )


def carry(rows: DataFrame, group: list, order: str, forward: dict[str, Column] | None = None,
          backward: dict[str, Column] | None = None) -> DataFrame:
    """Nearest non-null values before and after each row, all in one pass.

    ``forward`` names get the last value strictly before the row; ``backward``
    names the first one from the row on, its own included. ``rows`` is chunked
    and stays so.
    """
    specs = [(n, v, False) for n, v in (forward or {}).items()] + [(n, v, True) for n, v in (backward or {}).items()]
    names = {n: (f"__value_{i}", f"__brought_{i}") for i, (n, _, _) in enumerate(specs)}
    rows = rows.withColumns({names[n][0]: v for n, v, _ in specs})
    by_row, by_chunk, by_span = W.partitionBy(*group, CHUNK), W.partitionBy(*group, _SPAN), W.partitionBy(*group)
    brought = rows.groupBy(*group, CHUNK).agg(*[
        (F.min_by if back else F.max_by)(
            F.col(names[n][0]), F.when(F.col(names[n][0]).isNotNull(), F.col(order))).alias(names[n][1])
        for n, _, back in specs]).withColumn(_SPAN, int_div(CHUNK, F.lit(_SPAN_CHUNKS)))
    spans = brought.groupBy(*group, _SPAN).agg(*[
        (F.min_by if back else F.max_by)(
            F.col(names[n][1]), F.when(F.col(names[n][1]).isNotNull(), F.col(CHUNK))).alias(f"{names[n][1]}_far")
        for n, _, back in specs])
    near = {}
    for n, _, back in specs:
        value, kept = names[n]
        chunks = by_chunk.orderBy(F.col(CHUNK).desc() if back else F.col(CHUNK).asc())
        brought = brought.withColumn(
            kept, F.last(kept, ignorenulls=True).over(chunks.rowsBetween(W.unboundedPreceding, -1)))
        beyond = by_span.orderBy(F.col(_SPAN).desc() if back else F.col(_SPAN).asc())
        spans = spans.withColumn(
            f"{kept}_far", F.last(f"{kept}_far", ignorenulls=True).over(beyond.rowsBetween(W.unboundedPreceding, -1)))
        own = by_row.orderBy(F.col(order).desc() if back else F.col(order).asc()).rowsBetween(
            W.unboundedPreceding, 0 if back else -1)
        near[n] = F.last(value, ignorenulls=True).over(own)
    brought = brought.join(spans, [*group, _SPAN]).withColumns(
        {k: F.coalesce(k, f"{k}_far") for _, k in names.values()}).drop(_SPAN, *[f"{k}_far" for _, k in names.values()])
    out = rows.withColumns(near).join(brought, [*group, CHUNK])
    return out.withColumns({n: F.coalesce(n, names[n][1]) for n in names}).drop(*[x for pair in names.values() for x in pair])
