"""Schema descriptions: catalog documents, description files, comments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENT = (
    "file string, doc_no int, type string, schema string, name string, description string, sql string, "
    "columns array<struct<name: string, description: string>>")
FIELDS = ["file", "doc_no", "type", "schema", "name", "description", "sql", "columns"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of multi-document YAML files, one row each.

    The YAML reading is the only Python step; it runs in the tasks, a file at
    a time, and needs PyYAML there.
    """
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))

    def parse(frames):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML catalogs needs PyYAML on the executors") from e
        for frame in frames:
            for file, text in zip(frame["file"], frame["text"]):
                docs = [d for d in yaml.safe_load_all(text) if d]
                yield pd.DataFrame([{
                    "file": file, "doc_no": i, "type": d.get("type"), "schema": d.get("schema"), "name": d.get("name"),
                    "description": d.get("description"), "sql": d.get("sql"),
                    "columns": [{"name": str(c.get("name")), "description": c.get("description")}
                                for c in d["columns"]] if d.get("columns") else None,
                } for i, d in enumerate(docs)], columns=FIELDS)

    return texts.mapInPandas(parse, DOCUMENT)


def table_docs(documents: DataFrame) -> DataFrame:
    return documents.filter("type = 'table'").select("file", "schema", "name", "description", "columns")


def column_docs(documents: DataFrame) -> DataFrame:
    """One row per described column, in document order."""
    return table_docs(documents).select(
        "file", "schema", F.col("name").alias("table"), F.posexplode("columns").alias("ordinal", "c")).select(
        "file", "schema", "table", "ordinal", F.col("c.name").alias("column"), F.col("c.description").alias("description"))


def facts(documents: DataFrame) -> DataFrame:
    return documents.filter("type = 'fact'").select("file", "doc_no", "description")


def sql_examples(documents: DataFrame) -> DataFrame:
    return documents.filter("type = 'sql_example'").select("file", "doc_no", "description", "sql")


def read_description_csv(spark: SparkSession, path: str) -> DataFrame:
    """(table, column, description, extra) of column description files.

    Latin-1, header skipped, fields 0, 2 and 4; the file's stem names the table.
    """
    from ..functions.text import sentence

    raw = (
        spark.read.schema("c0 string, c1 string, c2 string, c3 string, c4 string")
        .option("header", True).option("encoding", "ISO-8859-1").option("multiLine", True).option("escape", '"').csv(path))
    blank = F.lit("")
    return raw.select(
        F.lower(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.csv$", 1)).alias("table"),
        F.trim("c0").alias("column"), F.trim(F.coalesce("c2", blank)).alias("description"),
        F.trim(F.coalesce("c4", blank)).alias("extra"),
    ).withColumn("comment", sentence("description", "extra"))


def read_table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(table, column, description) of nested table metadata JSON."""
    schema = "table_metadata map<string, array<struct<column_name: string, data_type: string, column_description: string>>>"
    per_table = spark.read.schema(schema).option("multiLine", True).json(path).select(
        F.explode("table_metadata").alias("table", "columns"))
    return per_table.select("table", F.inline("columns")).select(
        "table", F.col("column_name").alias("column"), "data_type", F.col("column_description").alias("description"))


def matched_comments(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Comment per (table, column): by exact name, else by lower-case name.

    ``columns(table, column)`` are the real ones; a description whose name
    fits neither way is left out. Of several for one column the last counts, by
    ``ordinal`` where there is one, else by text.
    """
    last = F.max_by("comment", F.struct(*[n for n in ("ordinal", "comment") if n in descriptions.columns]))
    keyed = descriptions.filter("comment IS NOT NULL").groupBy(F.col("table").alias("__t"), F.col("column").alias("__c")).agg(
        last.alias("comment"), *([F.max("ordinal").alias("ordinal")] if "ordinal" in descriptions.columns else []))
    exact = columns.join(keyed, (F.col("table") == F.col("__t")) & (F.col("column") == F.col("__c")), "left") \
        .drop("__t", "__c", "ordinal").withColumnRenamed("comment", "__exact")
    lowered = keyed.groupBy("__t", F.lower("__c").alias("__c")).agg(last.alias("__low"))
    return (
        exact.join(lowered, (F.col("table") == F.col("__t")) & (F.col("column") == F.col("__c")), "left")
        .withColumn("comment", F.coalesce("__exact", "__low")).drop("__t", "__c", "__exact", "__low"))


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Put column descriptions into the schema's metadata; saved with the data."""
    for field in df.schema.fields:
        note = comments.get(field.name, comments.get(field.name.lower()))
        if note is not None:
            df = df.withMetadata(field.name, {**(field.metadata or {}), "comment": note})
    return df


def comments_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["comment"] for f in df.schema.fields if f.metadata and "comment" in f.metadata}


def described(df: DataFrame, documents: DataFrame, schema: str, table: str) -> DataFrame:
    """``df`` with the comments its catalog document gives its columns."""
    wanted = column_docs(documents).filter((F.col("schema") == schema) & (F.col("table") == table))
    # one entry per column of one table
    return with_comments(df, {r["column"]: r["description"] for r in wanted.select("column", "description").collect()})


def comment_on_table(spark: SparkSession, table: str, text: str) -> None:
    """Description of a saved table."""
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {table} IS '{quoted}'")


def save_described(df: DataFrame, table: str, description: str | None = None, path: str | None = None) -> None:
    """Save as a catalog table in full; column comments come with the schema.

    The files go to the warehouse, or to ``path``.
    """
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    if description is not None:
        comment_on_table(df.sparkSession, table, description)


def save_config(spark: SparkSession, path: str, **values: str) -> None:
    """Key / value settings such as the catalog in use; replaces the old ones."""
    spark.createDataFrame(sorted(values.items()), "name string, value string").coalesce(1).write.mode(
        "overwrite").parquet(path)


def read_config(spark: SparkSession, path: str, name: str) -> str | None:
    row = spark.read.parquet(path).filter(F.col("name") == name).select("value").first()
    return row["value"] if row else None
