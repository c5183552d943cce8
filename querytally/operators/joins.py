"""Join shapes whose plain SQL form would broadcast or gather too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import _col


def matching(left: DataFrame, right: DataFrame, left_key: str, right_key: str, keep=True) -> DataFrame:
    """Rows of ``left`` with (``keep``) or without a partner in ``right``.

    The keys of ``right`` are made distinct first: repeats of a hot key combine
    before the shuffle, which the join then shares.
    """
    keys = right.select(F.col(right_key).alias("__key")).filter("__key is not null").distinct()
    return left.join(keys, F.col(left_key) == F.col("__key"), "left_semi" if keep else "left_anti")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` where ``left_key NOT IN (SELECT right_key ...)``.

    SQL's null rules hold: an empty list keeps every row, a null in the list
    keeps none, a null key is kept only by an empty list. Spark plans the SQL
    form as a broadcast of the whole list; this one is an ordinary anti join
    plus one row of counts, so the list may be of any size.
    """
    counts = right.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(right_key).alias("known")))
    state = counts.toDF("s")
    n, known = state.select("s.n").scalar(), state.select("s.known").scalar()
    return matching(left, right, left_key, right_key, keep=False).filter(
        (n == 0) | ((n == known) & F.col(left_key).isNotNull())
    )


def top_ranked(df: DataFrame, by: str) -> DataFrame:
    """Rows with DENSE_RANK() OVER (ORDER BY by DESC) = 1, nulls ranking first.

    Compared with a one-row aggregate instead of a window over everything.
    """
    best = df.agg(F.max(by).alias("best"), F.count_if(F.col(by).isNull()).alias("nulls"))
    top, nulls = best.select("best").scalar(), best.select("nulls").scalar()
    return df.filter(F.when(nulls > 0, F.col(by).isNull()).otherwise(F.col(by) == top))


def share_of_total(df: DataFrame, value: str, name="share") -> DataFrame:
    """``value`` divided by its sum over the frame."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.col(value) / F.nullif(total, F.lit(0.0)))


def above_average(df: DataFrame, value: Column, over: DataFrame | None = None) -> DataFrame:
    """Rows whose ``value`` exceeds its average over ``over`` (default: df)."""
    mean = (df if over is None else over).agg(F.avg(value)).scalar()
    return df.filter(value > mean)


def lookup_with_fallback(rows: DataFrame, entries: DataFrame, first: Column, second: Column,
                         entry_key: str, values: list) -> DataFrame:
    """Entry values by the first key, else by the second, else null.

    Of several entries with one key the greatest by its values counts. Both
    joins carry only key and values.
    """
    entries = entries.groupBy(_col(entry_key).alias("__entry")).agg(F.max(F.struct(*values)).alias("__v")).select("__entry", "__v.*")
    entry_key = "__entry"

    def side(tag):
        return entries.select(_col(entry_key).alias(f"__{tag}"), F.lit(True).alias(f"__{tag}_hit"),
                              *[F.col(v).alias(f"__{tag}_{v}") for v in values])

    out = (
        rows.withColumn("__k1", first).withColumn("__k2", second)
        .join(side("a"), F.col("__k1") == F.col("__a"), "left")
        .join(side("b"), F.col("__k2") == F.col("__b"), "left")
    )
    for v in values:
        out = out.withColumn(v, F.when(F.col("__a_hit"), F.col(f"__a_{v}")).otherwise(F.col(f"__b_{v}")))
    return out.drop("__k1", "__k2", *[f"__{t}{s}" for t in "ab" for s in ("", "_hit", *[f"_{v}" for v in values])])
