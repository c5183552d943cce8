"""Session factory, table loading and lineage cuts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def get_session(app="querytally", master=None, **conf) -> SparkSession:
    """UTC, ANSI, adaptive session. Without ``master`` the launcher decides."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="querytally-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _work_dir(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "querytally", spark.sparkContext.applicationId)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SCOPES = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Frames written between steps inside the block share a folder that is deleted at its end.

    Blocks nest, and each thread has its own. Read or store what you need
    before the end: a frame made inside the block may read the folder. Frames made
    outside it stay.

        with scratch(spark):
            compare_results(headers, rows, keys).write.parquet(path)
    """
    folder = os.path.join(_work_dir(spark), f"scope-{uuid.uuid4().hex}")
    scopes = vars(_SCOPES).setdefault("open", [])
    scopes.append(folder)
    try:
        yield folder
    finally:
        scopes.remove(folder)
        _delete(spark, folder)


def work_path(spark: SparkSession) -> str:
    """A new path in the shared folder, inside the surrounding ``scratch`` block if there is one."""
    scopes = vars(_SCOPES).get("open")
    return os.path.join(scopes[-1] if scopes else _work_dir(spark), uuid.uuid4().hex)


def written(df: DataFrame, compression="snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, keeps the result over executor loss, and fixes values
    such as partition numbers that a recomputation could assign differently.
    The files stay until the surrounding ``scratch`` block ends, else until
    ``release_written``.
    """
    spark = df.sparkSession
    path = work_path(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_written(spark: SparkSession) -> None:
    """Delete everything this application wrote between steps.

    Call it when no frame made so far is needed any more.
    """
    _delete(spark, _work_dir(spark))
