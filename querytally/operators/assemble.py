"""Ordered text assembly and the flattening of nested messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import int_div


# The layout of a table text.
TABLE_HEAD, TABLE_OPEN, TABLE_CLOSE = "CREATE TABLE ", "\n(\n", "\n);\n"
COLUMN_INDENT, COLUMN_NOTE, COLUMN_SEPARATOR = "    ", " -- ", ",\n"


def assembled(df: DataFrame, group: list, position: Column, line: Column, separator=COLUMN_SEPARATOR,
              name="text", per_piece=1000) -> DataFrame:
    """Lines of a group joined in order, in numbered pieces of bounded length.

    ``position`` is an integer, unique in its group. A piece covers
    ``per_piece`` positions, so no row or task has to hold a whole large group,
    and the one shuffle is by (group, piece).
    """
    rows = df.select(*group, position.alias("__at"), line.alias("__line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__line"))), lambda r: r["__line"])
    return rows.groupBy(*group, int_div("__at", F.lit(per_piece)).alias("piece")).agg(
        F.array_join(lines, separator).alias(name))


def column_line(name, data_type, nullable, comment) -> Column:
    """'    name type NOT NULL -- comment' as in a table definition."""
    null = F.when(nullable, F.lit("NULL")).otherwise(F.lit("NOT NULL"))
    note = F.when(F.col(comment).isNotNull(), F.concat(F.lit(COLUMN_NOTE), F.col(comment))).otherwise(F.lit(""))
    return F.concat(F.lit(COLUMN_INDENT), F.col(name), F.lit(" "), F.col(data_type), F.lit(" "), null, note)


def table_texts(columns: DataFrame, table="table_name", order="ordinal", per_piece=2000) -> DataFrame:
    """Table definitions from a column listing (name, data_type, nullable, comment).

    ``order`` numbers a table's columns, from any start and with any gaps. A
    table with columns in several pieces has its head in the first, its close in
    the last and separators between them: the pieces joined in order are one text.
    """
    body = assembled(columns, [table], F.col(order), column_line("column_name", "data_type", F.col("nullable"), "comment"),
                     name="body", per_piece=per_piece)
    ends = columns.groupBy(F.col(table).alias("__table")).agg(
        int_div(F.min(order), F.lit(per_piece)).alias("__first"), int_div(F.max(order), F.lit(per_piece)).alias("__last"))
    head = F.when(F.col("piece") == F.col("__first"), F.concat(F.lit(TABLE_HEAD), F.col(table), F.lit(TABLE_OPEN))).otherwise(F.lit(""))
    close = F.when(F.col("piece") == F.col("__last"), F.lit(TABLE_CLOSE)).otherwise(F.lit(COLUMN_SEPARATOR))
    return body.join(ends, F.col(table) == F.col("__table")).select(table, "piece", F.concat(head, "body", close).alias("ddl"))


def tree_digests(pieces: DataFrame, group: list, piece="piece", text="ddl", fan=256) -> DataFrame:
    """``group`` columns and the digest of a text that is spread over numbered pieces, whole numbers from 0.

    The digests of ``fan`` neighbouring pieces, joined in order, are digested, and so on level by level until
    one is left; one without neighbours goes up as it is. Every level is spread over
    all tasks, so a text of any size meets in no task. An empty frame gives none.
    """
    top = pieces.agg(F.max(piece)).first()[0]
    level = pieces.select(*group, F.col(piece).alias("__at"), F.md5(text).alias("digest"))
    while top:
        listed = F.array_sort(F.collect_list(F.struct("__at", "digest")))  # up to fan rows
        joined = level.groupBy(*group, int_div("__at", F.lit(fan)).alias("__up")).agg(listed.alias("__d"))
        whole = F.when(F.size("__d") == 1, F.col("__d")[0]["digest"]).otherwise(F.md5(F.array_join(F.col("__d.digest"), "")))
        level, top = joined.select(*group, F.col("__up").alias("__at"), whole.alias("digest")), top // fan
    return level.select(*group, "digest")


def message_rows(messages: DataFrame, keys: list, column="messages") -> DataFrame:
    """One row per message part.

    ``messages`` is a list of (request, response) pairs, each with ``parts`` of
    (kind, content, tool_name, arguments); tool calls get the role 'tool'.
    """
    pairs = messages.select(*keys, F.posexplode(column).alias("pair_no", "pair"))
    sides = pairs.select(*keys, "pair_no", F.posexplode(F.array("pair.request", "pair.response")).alias("side_no", "m"))
    parts = sides.filter("m is not null").select(
        *keys, "pair_no", "side_no", F.posexplode("m.parts").alias("part_no", "p"))
    tool = F.col("p.kind") == "tool-call"
    role = F.when(tool, F.lit("tool")).when(F.col("p.kind") == "system-prompt", F.lit("system")).when(
        F.col("p.kind") == "user-prompt", F.lit("user"))
    return parts.select(
        *keys, "pair_no", "side_no", "part_no", role.alias("role"),
        F.when(~tool, F.col("p.content")).alias("content"),
        F.when(tool, F.col("p.tool_name")).alias("tool_name"),
        F.when(tool, F.col("p.arguments")).alias("arguments")).filter("role is not null")
