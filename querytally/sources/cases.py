"""The corpus of evaluation cases and the question files it is built from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import file_system, write_row_files

CASE = "database string, question string, query string"
QUESTION = "db_id string, question string, evidence string, query string, SQL string"


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """Every ``{dataset}/evals/{name}/eval.json`` under ``root``."""
    # the path is a URI; a plus sign stands for itself in it
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.schema(CASE).option("multiLine", True).json(f"{root}/*/evals/*/eval.json")
        .select(F.regexp_extract(path, r"/([^/]+)/evals/[^/]+/[^/]+$", 1).alias("dataset"),
                F.regexp_extract(path, r"/evals/([^/]+)/[^/]+$", 1).alias("name"),
                "database", "question", "query"))


def read_questions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Question files (JSON arrays) in the given order, or all below a folder in the order of their paths.

    ``file_no`` and ``row_no`` keep the order; a file is one JSON document, so
    its rows come from one task and count up. A folder is one scan, however many files it holds.
    """
    from ..operators.corpus import append_in_order

    def read(path):
        return spark.read.schema(QUESTION).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn(
            "row_no", F.monotonically_increasing_id())

    if isinstance(paths, str):
        found = read(paths).withColumn("file_no", F.col("_metadata.file_path"))
    else:
        found = append_in_order(*[read(p) for p in paths])
    return found.select(
        "file_no", "row_no", F.col("db_id").alias("database"), "question", "evidence",
        F.coalesce("query", "SQL").alias("query"))


def build_cases(questions: DataFrame, dataset: str, databases: DataFrame | None = None) -> DataFrame:
    """Cases of a data set: known databases only, numbered, texts made ready.

    ``databases`` is a frame with the known ``database`` names.
    """
    from ..functions.text import double_to_single_quotes, question_with_evidence
    from ..operators.corpus import renumber

    if databases is not None:
        questions = questions.join(databases.select("database"), "database", "left_semi")
    text = F.when(F.col("evidence").isNull(), F.col("question")).otherwise(
        question_with_evidence("question", "evidence"))
    return renumber(questions, ["file_no", "row_no"]).select(
        F.lit(dataset).alias("dataset"), "name", "database", text.alias("question"),
        double_to_single_quotes("query").alias("query"))


def write_cases(cases: DataFrame, path: str) -> None:
    """``{dataset}/evals/{name}/eval.json`` under ``path``, as ``read_cases`` reads it.

    Tasks write the files and move them to their places (``files.write_row_files``): a case written
    before is replaced, and a run that fails in writing leaves all as it was. Keys must be fit for folder names. Where
    only Spark's own classes reach the file system, Spark writes a folder per case and the files are
    renamed one by one, streamed over the listing.
    """
    if file_system(path) is not None:
        place = F.concat("dataset", F.lit("/evals/"), "name", F.lit("/eval.json"))
        write_row_files(cases.select(place.alias("path"), F.to_json(F.struct("database", "question", "query")).alias("text")), path, depth=4)
        return
    spark = cases.sparkSession
    rough = f"{path}/_written-{uuid.uuid4().hex}"
    cases.write.partitionBy("dataset", "name").json(rough)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = spark.read.schema(f"{CASE}, dataset string, name string").json(rough).select(
        F.col("_metadata.file_path").alias("file"), "dataset", "name").distinct().toLocalIterator()
    for r in listed:
        to = hadoop.Path(f"{path}/{r['dataset']}/evals/{r['name']}/eval.json")
        fs.mkdirs(to.getParent())
        fs.delete(to, False)
        fs.rename(hadoop.Path(spark._jvm.java.net.URI(r["file"])), to)
    fs.delete(hadoop.Path(rough), True)
