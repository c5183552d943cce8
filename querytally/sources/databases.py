"""Databases of a data-set tree, and databases as folders of Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def discover_databases(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, database) pairs under ``root``.

    A data set's ``databases.json`` list wins, an empty one too; otherwise each ``.sql`` file of
    its ``databases`` folder is one, a dump in several parts counting once.
    """
    listed = _listing(spark, root, "databases.json")
    declared = None
    if not listed.isEmpty():
        texts = spark.read.text(f"{root}/*/databases.json", wholetext=True).select(
            F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/databases\.json$", 1).alias("dataset"), "value")
        declared = texts.select("dataset", F.explode(F.from_json("value", "array<string>")).alias("database"))
    files = _listing(spark, root, "*.sql")
    stem = F.regexp_extract("path", r"/([^/]+)\.sql$", 1)
    found = files.filter(F.col("path").rlike(r"/databases/[^/]+\.sql$")).select(
        F.regexp_extract("path", r"/([^/]+)/databases/[^/]+$", 1).alias("dataset"),
        F.regexp_replace(stem, r"\.part\d{3}$", "").alias("database"), stem.rlike(r"\.part(?!000$)").alias("later"))
    found = found.filter("not later").drop("later").distinct()
    if declared is None:
        return found
    return declared.unionByName(found.join(texts.select("dataset").distinct(), "dataset", "left_anti"))


def _listing(spark, root, glob) -> DataFrame:
    """File paths only; file contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .load(root).select("path"))


def database_id(dataset, database) -> Column:
    return F.concat_ws("_", dataset, database)


def replace_table(df: DataFrame, directory: str, name: str) -> None:
    """Load in full, replacing what was there.

    The new files are written beside the old ones and take their place by renames of whole folders when all
    are there: a load that fails leaves the old table, and ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    path, mark = spark._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    new, old, place = (path(f"{directory}/{n}") for n in (f"_new-{mark}", f"_old-{mark}", f"{name}.parquet"))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new.toString())
    except Exception:
        system.delete(new, True)
        raise
    if system.exists(place):
        system.rename(place, old)
    system.rename(new, place)
    system.delete(old, True)


def register_database(spark: SparkSession, directory: str, schema: str | None = None) -> list[str]:
    """Make every ``{name}.parquet`` of a folder queryable by its name.

    Temporary views, or tables of ``schema`` for queries that write
    ``schema.name``.
    """
    paths = _listing(spark, directory, "*.parquet").select(
        F.regexp_extract("path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1).alias("t")).distinct()
    names = sorted(r["t"] for r in paths.collect())  # one per table
    if schema is not None:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    for name in names:
        path = f"{directory}/{name}.parquet"
        if schema is None:
            spark.read.parquet(path).createOrReplaceTempView(f"`{name}`")
        else:
            spark.sql(f"DROP TABLE IF EXISTS `{schema}`.`{name}`")
            spark.catalog.createTable(f"`{schema}`.`{name}`", path=path, source="parquet")
    return names


def list_columns(spark: SparkSession, names=None, schema: str | None = None) -> DataFrame:
    """Columns with comments, ordered by schema, table and position.

    Reads the session's catalog: temporary views and the tables of ``schema``
    (default: the current one).
    """
    fields = "table_schema string, table_name string, ordinal int, column_name string, data_type string, nullable boolean, comment string"
    rows = []
    for entry in spark.catalog.listTables(schema):
        if names is not None and entry.name not in names:
            continue
        where = ".".join(f"`{p}`" for p in [*(entry.namespace or []), entry.name])
        for i, field in enumerate(spark.table(where).schema.fields):
            rows.append((".".join(entry.namespace or ["public"]), entry.name, i + 1, field.name,
                         field.dataType.simpleString(), field.nullable, (field.metadata or {}).get("comment")))
    return spark.createDataFrame(rows, fields).orderBy("table_schema", "table_name", "ordinal")


def with_defaults(df: DataFrame) -> DataFrame:
    """Text columns declared with an empty default: null becomes ''."""
    return df.na.fill("", [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


# PostgreSQL type names and the Spark types that hold them.
SPARK_TYPES = {
    "integer": "int", "int": "int", "smallint": "smallint", "bigint": "bigint", "text": "string",
    "real": "float", "double precision": "double", "boolean": "boolean", "timestamptz": "timestamp",
    "timestamp": "timestamp", "date": "date", "json": "string", "interval": "interval day to second",
}


def spark_type(declared: str) -> str:
    """Spark type of a PostgreSQL declaration; lengths of texts are dropped."""
    name = declared.strip().lower()
    if name in SPARK_TYPES:
        return SPARK_TYPES[name]
    base, _, size = name.partition("(")
    if base in ("numeric", "decimal"):
        return f"decimal({size}" if size else "decimal(38,18)"
    if base in ("character", "char", "character varying", "varchar"):
        return "string"
    raise ValueError(f"unknown type: {declared}")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast to their declared types; unreadable values are null
    and blank-padded characters lose their padding."""
    out = []
    for name in df.columns:
        column, declared = F.col(f"`{name}`"), types.get(name)
        if declared is not None:
            padded = declared.strip().lower().startswith(("character(", "char("))
            column = F.rtrim(column) if padded else column.try_cast(spark_type(declared))
        out.append(column.alias(name))
    return df.select(*out)
