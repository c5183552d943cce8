"""Text lines of files in file order, and writing them back in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line); ``line_no`` grows with the place in the file.

    A split starts at a byte offset and every line has at least one byte, so
    offset + index in the task orders the lines over splits without a shuffle.
    The numbers are unique per file but have gaps between splits.
    """
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start")
         + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("line_no"),
        F.col("value").alias("line"))


def write_parts(numbered: DataFrame, path: str) -> None:
    """One folder per (file, part), its lines in order in one file.

    A part is bounded by the split limit, so one task can write it.
    """
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.sql)?$", 1)
    (
        numbered.withColumn("file", stem).repartition("file", "part").sortWithinPartitions("file", "part", "line_no")
        .select("file", "part", "line").write.mode("overwrite").partitionBy("file", "part").text(path))
