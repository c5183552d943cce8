"""Descriptions and listings written by the sinks and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import int_div
from ..operators.numbering import number_within
from ..session import work_path
from ..sources import catalog, databases
from ..sources.files import write_row_files
from .registry import query

c = F.col
BLOCK = 1000  # suppliers of a file at most


def _suppliers(t):
    """Suppliers with their nation, their place ``at`` in it and the file it falls in."""
    rows = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "s_name", "n_name", "n_nationkey")
    placed = number_within(rows, ["n_name"], ["s_suppkey"], "at", start=0)
    return placed.withColumn("block", int_div("at", F.lit(BLOCK))).withColumn("file", F.concat("n_name", F.lit("-"), "block"))


@query("catalog_documents", f"""
    SELECT 'public' AS schema, n_name AS "table", CAST(place % {BLOCK} AS INTEGER) AS ordinal, s_name AS "column", 'Supplier "' || s_suppkey || '": #1' AS description
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def catalog_documents(t):
    """Files of several documents each: a table of up to BLOCK described columns between others that are no tables."""
    path = work_path(t.spark)
    one = F.struct("at", c("s_name").alias("name"), F.concat(F.lit('Supplier "'), "s_suppkey", F.lit('": #1')).alias("description"))
    files = _suppliers(t).groupBy("n_name", "file").agg(F.array_sort(F.collect_list(one)).alias("columns"))
    documents = [
        F.struct(F.lit("header").alias("type"), F.lit("1").alias("schema_version")),
        F.struct(F.lit("table").alias("type"), F.lit("public").alias("schema"), c("n_name").alias("name"),
                 F.transform("columns", lambda x: F.struct(x["name"], x["description"])).alias("columns")),
        F.struct(F.lit("fact").alias("type"), F.concat(F.lit("About "), "n_name").alias("description"))]
    # a JSON object is a YAML document
    text = F.concat(*[x for d in documents for x in (F.lit("--- "), F.to_json(d), F.lit("\n"))])
    write_row_files(files.select(F.concat("file", F.lit(".yaml")).alias("path"), text.alias("text")), path, depth=1)
    return catalog.column_docs(catalog.read_documents(t.spark, f"{path}/*.yaml")).drop("file")


@query("description_files", f"""
    SELECT LOWER(n_name) || '-' || place // {BLOCK} AS "table", s_name AS "column",
        'Seller ' || s_suppkey || ', "café".' || CASE WHEN s_suppkey % 2 = 0 THEN ' Größe ' || s_suppkey % 7 || '.' ELSE '' END AS comment
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def description_files(t):
    """Latin-1 files of column descriptions, named by table."""
    path = work_path(t.spark)
    line = F.concat(
        "s_name", F.lit(" ,x,\" Seller "), "s_suppkey", F.lit(', ""café"" ",y,'),
        F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("Größe "), c("s_suppkey") % 7)).otherwise(F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"])
    files = _suppliers(t).groupBy("file").agg(F.array_join(lines, "\n").alias("body"))
    text = F.concat(F.lit("original_column_name,column_name,column_description,data_format,value_description\n"), "body")
    write_row_files(files.select(F.concat("file", F.lit(".csv")).alias("path"), text.alias("text")), path, depth=1, encoding="latin-1")
    return catalog.read_description_csv(t.spark, f"{path}/*.csv").select("table", "column", "comment")


@query("found_databases", """
    SELECT 'd' || s_suppkey // 100 AS dataset, 'db' || s_suppkey AS database FROM supplier
    WHERE (s_suppkey // 100) % 3 <> 0 OR s_suppkey % 2 = 0""")
def found_databases(t):
    """A dump a supplier, some in parts, in folders of a hundred; every third folder lists its own, which are fewer."""
    path = work_path(t.spark)
    dataset = F.concat(F.lit("d"), int_div("s_suppkey", F.lit(100)))
    ends = F.when(c("s_suppkey") % 5 == 0, F.array(F.lit(".part000.sql"), F.lit(".part001.sql"))).otherwise(F.array(F.lit(".sql")))
    dumps = t.supplier.select(F.concat(dataset, F.lit("/databases/db"), "s_suppkey").alias("stem"), F.explode(ends).alias("end"))
    write_row_files(dumps.select(F.concat("stem", "end").alias("path"), F.lit("SELECT 1;").alias("text")), path, depth=3)
    named = F.array_compact(F.collect_list(F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("db"), "s_suppkey"))))  # a hundred at most
    lists = t.supplier.filter(int_div("s_suppkey", F.lit(100)) % 3 == 0).groupBy(dataset.alias("d")).agg(F.to_json(named).alias("text"))
    write_row_files(lists.select(F.concat("d", F.lit("/databases.json")).alias("path"), "text"), path, depth=2)
    return databases.discover_databases(t.spark, path)


@query("saved_descriptions", """
    SELECT CAST(ROW_NUMBER() OVER () AS INTEGER) AS ordinal, 'described' AS table_schema, 'customer' AS table_name, column_name,
        'About ' || column_name || ' of ' || (SELECT COUNT(*) FROM customer) || ' customers' AS comment,
        (SELECT COUNT(*) FROM customer) AS n_rows
    FROM (DESCRIBE customer)""")
def saved_descriptions(t):
    """The customers saved as a table of the schema that the settings name, with described columns, and listed."""
    path, count = work_path(t.spark), t.customer.count()
    catalog.save_config(t.spark, f"{path}/config", catalog="described", other="x")
    schema = catalog.read_config(t.spark, f"{path}/config", "catalog")
    t.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    t.spark.sql(f"DROP TABLE IF EXISTS `{schema}`.customer")
    comments = {n.upper() if i % 2 else n: f"About {n} of {count} customers" for i, n in enumerate(t.customer.columns)}
    found = t.spark.createDataFrame([("customer", n) for n in t.customer.columns], "table string, column string")
    given = t.spark.createDataFrame([("customer", n, text) for n, text in comments.items()], "table string, column string, comment string")
    matched = catalog.matched_comments(found, given)
    notes = {r["column"]: r["comment"] for r in matched.select("column", "comment").collect()}  # one table's columns
    catalog.save_described(catalog.with_comments(t.customer, notes), f"`{schema}`.customer", "The customers", f"{path}/customer")
    rows = t.spark.table(f"`{schema}`.customer").agg(F.count(F.lit(1)).alias("n_rows"))
    listed = databases.list_columns(t.spark, ["customer"], schema).filter(c("table_schema") == schema)
    return listed.select("ordinal", "table_schema", "table_name", "column_name", "comment", rows.scalar().alias("n_rows"))
