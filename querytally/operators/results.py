"""Query results in one long shape, so that many can be compared per pass.

``headers``: case keys, ``side`` ('actual' | 'expected'), ``kinds``, ``names``
``rows``:    case keys, ``side``, ``row_id``, ``kinds``, ``cells``

``kinds`` holds one letter per column (the type class) and ``cells`` the row's
values as canonical text, so results of any width share a schema and one row of
a result stays one row. An empty result has a header and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ACTUAL, EXPECTED = "actual", "expected"


def unique_names(names) -> list[str]:
    """Append ``_{index}`` to every column name that occurs more than once."""
    names = list(names)
    return [f"{n}_{at}" if names.count(n) > 1 else n for at, n in enumerate(names)]


def with_unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "i"
    if isinstance(dtype, T.DecimalType):
        return "d"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "f"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "s"
    if isinstance(dtype, T.BooleanType):
        return "b"
    if isinstance(dtype, T.DateType):
        return "t"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "z"
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "v"
    return "x"


def cell(column: Column, dtype: T.DataType) -> Column:
    """Canonical text: equal values of one kind give equal text."""
    kind = kind_of(dtype)
    if kind == "f":
        return F.when(column == 0, F.lit("0.0")).otherwise(column.cast("string"))
    if kind == "d":
        text = column.cast("decimal(38,18)").cast("string") if dtype.scale <= 18 and dtype.precision - dtype.scale <= 20 \
            else column.cast("string")
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def _keyed(df, case):
    return [F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in case.items()]


def result_header(df: DataFrame, case: dict, side: str) -> DataFrame:
    """One header row for a whole frame as the result of one case."""
    kinds = "".join(kind_of(f.dataType) for f in df.schema.fields)
    return df.sparkSession.range(0, 1, 1, 1).select(
        *_keyed(df, case), F.lit(side).alias("side"), F.lit(kinds).alias("kinds"),
        F.array(*[F.lit(n) for n in unique_names(df.columns)]).cast("array<string>").alias("names"),
    )


def result_columns(df: DataFrame, case: dict, side: str, values: list, row_id=None) -> list[Column]:
    """The columns of the long shape for the rows of ``df``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds = "".join(kind_of(types[v]) for v in values)
    cells = [cell(F.col(f"`{v}`"), types[v]) for v in values]
    return [
        *_keyed(df, case), F.lit(side).alias("side"),
        (F.monotonically_increasing_id() if row_id is None else row_id).cast("long").alias("row_id"),
        F.lit(kinds).alias("kinds"),
        (F.array(*cells) if cells else F.array()).cast("array<string>").alias("cells"),
    ]


def result_rows(df: DataFrame, case: dict, side: str, values=None, row_id=None) -> DataFrame:
    """Rows of ``df`` in the long shape.

    ``case`` maps key names to constants (one case) or columns (many cases in
    one frame); ``values`` picks the result columns, default all. Without a
    ``row_id`` the read order is used; write such rows before comparing them.
    """
    if values is None:
        df = with_unique_names(df)
        values = df.columns
    return df.select(*result_columns(df, case, side, values, row_id))
