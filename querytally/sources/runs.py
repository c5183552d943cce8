"""Run files and the report store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

USAGE = (
    "struct<cached_tokens: long, cached_tokens_cost: double, request_tokens: long, "
    "request_tokens_cost: double, response_tokens: long, response_tokens_cost: double>")
EVAL = (
    "struct<status: string, dataset: string, database: string, name: string, question: string, "
    "duration: double, details: string>")
SUMMARY = (
    f"struct<passing: long, total: long, total_duration: double, usage: {USAGE}, failed: array<string>, "
    f"failed_error_counts: map<string, long>, errored: array<string>, evals: array<{EVAL}>>")
RUN_FILE = (
    "task string, start_time timestamp, end_time timestamp, details string, "
    f"results map<string, {SUMMARY}>, _corrupt_record string")


def read_run_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): parsed run files, and (file, text) of unreadable ones.

    ``path`` is a folder of ``*.json`` files, one document each. Free-form
    details stay JSON text.
    """
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = texts.select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.from_json("value", RUN_FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("run"))
    broken = F.col("run").isNull() | F.col("run._corrupt_record").isNotNull()
    good = parsed.filter(~broken).select("file", "run.*").drop("_corrupt_record")
    bad = parsed.filter(broken).select("file", F.col("value").alias("text"))
    return good, bad


def write_run_files(run_files: DataFrame, path: str) -> None:
    """Nested run documents as JSON, one per line."""
    run_files.write.mode("append").json(path)


def read_run_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_FILE.rsplit(",", 1)[0]).json(path)


def append_report(run: DataFrame, evals: DataFrame, store: str, run_id: str | None = None) -> str:
    """Append one run row and its evals, which carry the run's id.

    ``run`` has source, start_time, end_time, task, scores, details. A call without ``run_id``
    stores a run of its own with a new id; the id is returned. The evals are written
    without a shuffle into a folder of the run; the run's row, one file that appears in one step, publishes
    them. An append that failed may be repeated with its id: it replaces what was left, and does nothing if the run is there.
    """
    run_id = run_id or uuid.uuid4().hex
    if run_id in _published(run.sparkSession, store):
        return run_id
    stamped = run.limit(1).select(
        F.lit(run_id).alias("id"), "source", F.coalesce("start_time", F.current_timestamp()).alias("start_time"),
        F.coalesce("end_time", F.current_timestamp()).alias("end_time"), "task", "scores", "details")
    evals.drop("run_id").withColumn("duration", F.col("duration").cast("decimal(18,3)")) \
        .write.mode("overwrite").parquet(f"{store}/evals/run_id={run_id}")
    stamped.coalesce(1).write.mode("append").parquet(f"{store}/runs")
    return run_id


def _folders(spark: SparkSession, path: str) -> list:
    """Hadoop statuses of the entries of a folder; none if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(system.listStatus(folder)) if system.exists(folder) else []


def _published(spark: SparkSession, store: str) -> set:
    """Ids of the runs whose row is there."""
    if not any(s.getPath().getName().endswith(".parquet") for s in _folders(spark, f"{store}/runs")):
        return set()
    return {r["id"] for r in spark.read.parquet(f"{store}/runs").select("id").collect()}


def read_report(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(runs, evals); evals of a run that is not published yet are not there."""
    runs = spark.read.parquet(f"{store}/runs")
    found = spark.read.parquet(f"{store}/evals").schema
    # an id in the folder's name is a text, also where it looks like a number
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name == "run_id" else f.dataType) for f in found])
    evals = spark.read.schema(texts).parquet(f"{store}/evals")
    return runs, evals.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(*evals.columns)


def drop_unpublished(spark: SparkSession, store: str) -> list[str]:
    """Delete the evals of runs without a row, left by appends that failed and were not repeated; their ids.

    No append may be running.
    """
    published, gone = _published(spark, store), []
    for status in _folders(spark, f"{store}/evals"):
        name = status.getPath().getName()
        if name.startswith("run_id=") and name[7:] not in published:
            status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).delete(status.getPath(), True)
            gone.append(name[7:])
    return sorted(gone)


def without_nans(column: Column, dtype: T.DataType) -> Column:
    """NaN and infinities become null, at any depth; decimals stay as they are."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
        return F.when(~bad, column)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: without_nans(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(column, lambda _, v: without_nans(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[without_nans(column[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(column.isNotNull(), inner)
    return column


def case_documents(records: DataFrame, keys: list) -> DataFrame:
    """Keys plus the record as a JSON text without NaN."""
    clean = [without_nans(F.col(f.name), f.dataType).alias(f.name) for f in records.schema.fields if f.name not in keys]
    return records.select(*keys, F.to_json(F.struct(*clean)).alias("document"))
