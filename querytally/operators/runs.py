"""Merging run files and answering questions about stored runs.

A run file row has task, start_time, end_time, details and
``results: map<dataset, summary>``. Merged lists stay rows: a data set's list
of failed names has no upper size.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import int_div, pass_ratio
from .numbering import number_within

# The usage fields of a summary.
USAGE = (
    "cached_tokens", "cached_tokens_cost", "request_tokens",
    "request_tokens_cost", "response_tokens", "response_tokens_cost",
)


def summaries(run_files: DataFrame) -> DataFrame:
    """One row per (run file, data set)."""
    return run_files.select(F.explode("results").alias("dataset", "summary")).select("dataset", "summary.*")


def merged_totals(run_files: DataFrame) -> DataFrame:
    """Counts, durations and usage per data set; a summary may lack usage."""
    zero = {f: F.lit(0.0 if f.endswith("_cost") else 0) for f in USAGE}
    return summaries(run_files).groupBy("dataset").agg(
        F.sum("passing").alias("passing"), F.sum("total").alias("total"),
        F.round(F.sum("total_duration"), 3).alias("total_duration"),
        *[F.sum(F.coalesce(f"usage.{f}", zero[f])).alias(f) for f in USAGE])


def with_overall(totals: DataFrame) -> DataFrame:
    """Add the row over all data sets and the pass ratio."""
    sums = [c for c in totals.columns if c != "dataset"]
    out = totals.rollup("dataset").agg(F.grouping("dataset").alias("g"), *[F.sum(c).alias(c) for c in sums])
    return (
        out.withColumn("level", F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.lit("dataset"))).drop("g")
        .withColumn("ratio", pass_ratio("passing", "total"))
    )


def merged_names(run_files: DataFrame, which: str) -> DataFrame:
    """(dataset, name) rows of the 'failed' or 'errored' lists."""
    return summaries(run_files).select("dataset", F.explode(which).alias("name"))


def merged_error_counts(run_files: DataFrame) -> DataFrame:
    exploded = summaries(run_files).select("dataset", F.explode("failed_error_counts").alias("exception_class", "n"))
    return exploded.groupBy("dataset", "exception_class").agg(F.sum("n").alias("n"))


def merged_evals(run_files: DataFrame) -> DataFrame:
    return summaries(run_files).select(F.inline("evals"))


def run_span(run_files: DataFrame) -> DataFrame:
    """Earliest start and latest end; files without a time are ignored."""
    return run_files.agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("start_time").desc_nulls_first(), F.col("id").asc())


def run_evals(runs: DataFrame, evals: DataFrame, run_id=None) -> DataFrame:
    """Evals joined to their run; with ``run_id`` only that partition is read."""
    if run_id is not None:
        runs, evals = runs.filter(F.col("id") == run_id), evals.filter(F.col("run_id") == run_id)
    return evals.join(runs.select(F.col("id").alias("run_id"), "source", "start_time"), "run_id")


def with_run_header(files: DataFrame, task: str, start_time, end_time, details: dict | None = None) -> DataFrame:
    """The header fields every file of a run repeats; details as JSON text."""
    return files.select(
        F.lit(task).alias("task"), F.lit(start_time).cast("timestamp").alias("start_time"),
        F.lit(end_time).cast("timestamp").alias("end_time"), F.lit(json.dumps(details or {})).alias("details"), "results")


def run_documents(evals: DataFrame, run: list, per_file=1000) -> DataFrame:
    """Run files of bounded size from evals: one row per (run, data set, piece).

    ``evals`` has dataset, database, name, question, status, duration, the
    usage fields and exception_class. A data set of any size continues over
    several files; merging run files puts it together again.
    """
    fields = ["database", "name", "question", "status", "duration", "exception_class", *USAGE]
    placed = number_within(evals.select(*run, "dataset", *fields), [*run, "dataset"], ["name"], "__n", start=0)
    one = F.struct("__n", "dataset", *fields)
    files = placed.withColumn("piece", int_div("__n", F.lit(per_file))).groupBy(*run, "dataset", "piece").agg(
        F.array_sort(F.collect_list(one)).alias("rows"),
        F.count_if(F.col("status") == "pass").alias("passing"), F.count(F.lit(1)).alias("total"),
        F.round(F.sum("duration"), 3).alias("total_duration"),
        F.struct(*[F.sum(f).alias(f) for f in USAGE]).alias("usage"))

    def names(status):
        return F.transform(F.filter("rows", lambda r: r["status"] == status), lambda r: r["name"])

    classes = F.transform(F.filter("rows", lambda r: r["status"] == "error"), lambda r: r["exception_class"])
    counts = F.map_from_entries(F.transform(
        F.array_distinct(classes),
        lambda e: F.struct(e, F.size(F.filter(classes, lambda x: x == e)).cast("long"))))
    evals_out = F.transform("rows", lambda r: F.struct(
        r["status"].alias("status"), r["dataset"].alias("dataset"), r["database"].alias("database"),
        r["name"].alias("name"), r["question"].alias("question"), r["duration"].alias("duration"),
        F.struct(r["exception_class"].alias("exception_class")).alias("details")))
    summary = F.struct(
        "passing", "total", "total_duration", "usage", names("fail").alias("failed"),
        counts.alias("failed_error_counts"), names("error").alias("errored"), evals_out.alias("evals"))
    return files.select(*run, "piece", F.create_map(F.col("dataset"), summary).alias("results"))
