"""Cleaning and splitting of SQL dump texts, line by line, files of any size.

Input lines are ``(file, line_no, line)`` with an integer position per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import int_div
from ..functions.text import is_blank, starts_with_any
from .ordered import CHUNK, carry, chunked, running_sum

# Size limit of a dump part, and what ends a statement's line.
PART_BYTES = 95 * 1024 * 1024
STATEMENT_ENDS = ("';", ");")
SESSION_LINES = ("SELECT", "SET")
COMMENT = "--"

_SALTS = 64


def lines_of(texts: DataFrame, file: str, text: str) -> DataFrame:
    """Lines of a text column, numbered from 0."""
    return texts.select(
        F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def strip_lines(lines: DataFrame, chunk_rows=65536) -> DataFrame:
    """Drop session lines, comments at the start or after a blank line, blank
    lines at both ends and all but the first of consecutive blank lines.

    Which comments and blanks stay depends only on the nearest earlier line
    that is no comment, and on whether any text still follows, so both come from one carry each way.
    """
    kept = lines.filter(~starts_with_any("line", SESSION_LINES))
    kept = kept.withColumn("__comment", F.col("line").startswith(COMMENT)).withColumn("__blank", is_blank("line"))
    plain = ~F.col("__comment")
    kept = carry(
        chunked(kept, "line_no", chunk_rows), ["file"], "line_no",
        forward={"__after_blank": F.when(plain, F.col("__blank"))},
        backward={"__more": F.when(plain & ~F.col("__blank"), F.lit(True))})
    text = plain & ~F.col("__blank")
    follows_text = F.coalesce(~F.col("__after_blank"), F.lit(False))
    stays = text | (follows_text & (F.col("__comment") | F.col("__more").isNotNull()))
    return kept.filter(stays).drop("__comment", "__blank", "__after_blank", "__more", CHUNK)


def part_numbers(lines: DataFrame, limit=PART_BYTES, chunk_rows=65536) -> DataFrame:
    """Part number of every line so that parts end with a statement.

    A statement ending at byte e goes to the window floor((e - 1) / limit);
    windows are numbered consecutively. Text after the last statement is a part
    of its own, a file within the limit is one part, and a statement larger
    than the limit stays whole.
    """
    size = F.octet_length("line") + 1
    placed = running_sum(chunked(lines, "line_no", chunk_rows), ["file"], "line_no", size, "__end")
    ends = F.lit(False)
    for mark in STATEMENT_ENDS:
        ends = ends | F.col("line").endswith(mark)
    placed = carry(placed, ["file"], "line_no", backward={"__stmt_end": F.when(ends, F.col("__end"))})
    window = int_div(F.col("__stmt_end") - 1, F.lit(limit))
    placed = placed.withColumn("__window", window)
    # one row per (file, window), numbered per file: file size / limit of them
    windows = placed.groupBy("file", "__window").agg(F.max("__end").alias("__last"))
    whole = W.partitionBy("file")
    numbered = windows.select(
        "file", "__window", F.max("__last").over(whole).alias("__size"), F.count("__window").over(whole).alias("__tail"),
        (F.row_number().over(whole.orderBy(F.col("__window").asc_nulls_last())) - 1).alias("__part"))
    # Lines of one window, and all lines behind the last statement, may be most of a file: the
    # numbers are copied to a few salts, so that neither meets them in one task.
    salt = F.pmod(F.xxhash64("line_no"), F.lit(_SALTS))
    copies = numbered.select(
        F.col("file").alias("__f"), F.col("__window").alias("__w"), "__size", "__tail", "__part",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("__salt"))
    part = F.when(F.col("__size") <= limit, F.lit(0)).when(F.col("__window").isNull(), F.col("__tail")).otherwise(F.col("__part"))
    return placed.withColumn("__own", salt).join(
        copies, (F.col("file") == F.col("__f")) & (F.col("__own") == F.col("__salt")) & F.col("__window").eqNullSafe(F.col("__w"))) \
        .select("file", "line_no", "line", F.col("__end").alias("end_offset"), part.cast("int").alias("part"))
