"""Run the query texts of cases and keep the results in the long shape."""

from __future__ import annotations

import contextlib
import itertools
import threading
import time
import traceback
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, functions as F

from .compare import compare_results
from .results import kind_of, result_rows, unique_names, with_unique_names
from .scoring import scored

HEADER = (
    "dataset string, name string, side string, kinds string, names array<string>, "
    "n_rows long, seconds double, error_class string, error string, trace string")

ROWS = "dataset string, name string, side string, row_id long, kinds string, cells array<string>"


@contextlib.contextmanager
def _limited(spark, limit):
    """Jobs that this thread starts inside the block are interrupted after ``limit`` seconds."""
    if limit is None:
        yield
        return
    context, tag = spark.sparkContext, f"case-{uuid.uuid4().hex}"
    timer = threading.Timer(limit, context.cancelJobsWithTag, [tag])
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _query_rows(spark, case, side, path):
    """Write the rows of a case's query; (kinds, names, number of rows)."""
    df = with_unique_names(spark.sql(case["query"].rstrip().rstrip(";")))
    seen = Observation()
    rows = result_rows(df, {"dataset": case["dataset"], "name": case["name"]}, side)
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return "".join(kind_of(f.dataType) for f in df.schema.fields), unique_names(df.columns), seen.get["n"]


def _run_one(spark, case, side, path, limit=None):
    """Write one query's rows and header, each in place of an earlier run's; the header tells how it went."""
    start, kinds, names, n_rows, error = time.time(), None, None, None, None
    place = f"{side}/{case['dataset']}/{case['name']}"
    try:
        with _limited(spark, limit):
            kinds, names, n_rows = _query_rows(spark, case, side, f"{path}/rows/{place}")
    except Exception as e:  # the query's fault, whatever it is
        error = e
    if error is not None:
        spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{path}/rows/{place}")
    header = (
        case["dataset"], case["name"], side, kinds, names, n_rows, round(time.time() - start, 3),
        type(error).__name__ if error else None, str(error) if error else None,
        "".join(traceback.format_exception(error)) if error else None)
    spark.createDataFrame([header], HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/headers/{place}")


def run_cases(cases: DataFrame, side: str, path: str, prepare=None, parallel=4, limit=None) -> None:
    """Execute ``cases(dataset, name, database, query)`` and store the results.

    Every query is a Spark job whose rows go straight to files under ``path``, in
    a folder of the case and side: a case that runs again replaces its result.
    The case list streams through the driver, ``parallel`` cases at a time: a slow case holds its own place
    only, the next cases of its database go on beside it. A query that runs for more than ``limit`` seconds is
    interrupted and recorded as an error.
    ``prepare(dataset, database)`` makes a database's tables visible before its
    queries. A failing query is recorded by error class, message and trace, and the others go on.
    """
    spark = cases.sparkSession
    listed = cases.select("dataset", "name", "database", "query").orderBy("dataset", "database", "name").toLocalIterator()
    for (dataset, database), group in itertools.groupby(listed, key=lambda r: (r["dataset"], r["database"])):
        if prepare:
            prepare(dataset, database)
        free = threading.Semaphore(2 * parallel)  # cases taken from the list and not done
        waiting = []
        with ThreadPoolExecutor(parallel) as pool:
            for case in group:
                free.acquire()
                done = pool.submit(_run_one, spark, case, side, path, limit)
                done.add_done_callback(lambda _: free.release())
                waiting = [w for w in waiting if not w.done() or w.result()]
                waiting.append(done)
            for w in waiting:
                w.result()


def read_outcomes(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, rows) as written; a case that failed has no kinds."""
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.schema(HEADER).parquet(f"{path}/headers"), reader.schema(ROWS).parquet(f"{path}/rows")


def judged(headers: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """Status of every case whose expected query worked."""
    keys = ["dataset", "name"]
    verdicts = compare_results(headers.filter("error_class is null"), rows, keys, **options)

    def of(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    ends = headers.groupBy(*keys).agg(
        of("expected", "error_class").alias("golden_error"), of("actual", "error_class").alias("exception_class"),
        of("actual", "error").alias("exception"), of("actual", "trace").alias("trace"), of("actual", "seconds").alias("duration"))
    outcome = ends.join(verdicts, keys, "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return scored(outcome.withColumn("candidate_error", F.col("exception_class"))).drop("candidate_error")
