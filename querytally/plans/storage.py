"""Round trips: given tables written by the sinks, read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..operators.compare import frames_equal
from ..operators.numbering import number_within
from ..session import work_path, written
from ..sources import cases as case_files, catalog, databases, runs as run_files
from .evaluation import CASES_SQL, USAGE_SQL, run_evals
from .registry import query

c = F.col

BLOCK = 50_000  # rows of a JSON document at most


def in_blocks(rows, key, order):
    """``rows`` with ``block``, which numbers each ``key``'s runs of BLOCK rows in order."""
    return number_within(rows, [key], [order], "n", start=0).withColumn("block", F.expr(f"n div {BLOCK}")).drop("n")


@query("case_files", """
    SELECT 'd' || (s_nationkey % 3) AS dataset, LPAD(CAST(s_suppkey AS VARCHAR), 8, '0') AS name, n_name AS database,
           'Who is "' || s_name || '"?' AS question, 'SELECT ' || s_suppkey AS query
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def cases_written_and_read(t):
    """Suppliers as cases, a file each, in the layout that is read."""
    path = work_path(t.spark)
    case_files.write_cases(t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select(
        F.concat(F.lit("d"), c("s_nationkey") % 3).alias("dataset"), F.lpad(c("s_suppkey").cast("string"), 8, "0").alias("name"),
        c("n_name").alias("database"), F.concat(F.lit('Who is "'), "s_name", F.lit('"?')).alias("question"),
        F.concat(F.lit("SELECT "), "s_suppkey").alias("query")), path)
    return case_files.read_cases(t.spark, path)


@query("question_files", """
    WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS r, COUNT(*) OVER (PARTITION BY n_regionkey) AS k
               FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT 'q' || n_regionkey AS dataset, LPAD(CAST(r AS VARCHAR), CAST(LENGTH(CAST(k AS VARCHAR)) AS INT), '0') AS name, n_name AS database,
           'Where is ' || s_name || '?' || CHR(10) || 'in ' || n_name AS question, 'select ''' || s_name || '''' AS query
    FROM s""")
def questions_written_and_read(t):
    """Question files of each region, a JSON array of up to BLOCK of its suppliers each, made into cases."""
    path, out = work_path(t.spark), None
    # a place in the path as text, so that paths sort like blocks
    numbered = F.lpad(c("block").cast("string"), 12, "0")
    one = F.struct("s_suppkey", c("n_name").alias("db_id"), F.concat(F.lit("Where is "), "s_name", F.lit("?")).alias("question"),
                   F.concat(F.lit("in "), "n_name").alias("evidence"), F.concat(F.lit('select "'), "s_name", F.lit('"')).alias("SQL"))
    blocks = in_blocks(t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")), "n_regionkey", "s_suppkey").groupBy(
        "n_regionkey", numbered.alias("block")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("value"))
    blocks.write.partitionBy("n_regionkey", "block").text(path)
    for region in sorted(r["n_regionkey"] for r in t.nation.select("n_regionkey").distinct().collect()):
        if not t.supplier.join(t.nation.filter(c("n_regionkey") == region), c("s_nationkey") == c("n_nationkey"), "left_semi").isEmpty():
            built = case_files.build_cases(case_files.read_questions(t.spark, f"{path}/n_regionkey={region}"), f"q{region}")
            out = built if out is None else out.unionByName(built)
    return out


MERGED_SQL = f"""
    SELECT dataset, COUNT(*) FILTER (WHERE status = 'pass') AS passing, COUNT(*) AS total, ROUND(SUM(duration), 2) AS total_duration,
           CAST(SUM(request_tokens) AS BIGINT) AS request_tokens, ROUND(SUM(request_tokens_cost), 7) AS request_tokens_cost
    FROM ({USAGE_SQL}) GROUP BY dataset"""


def _merged(files):
    return runs.merged_totals(files).select(
        "dataset", "passing", "total", F.round("total_duration", 2).alias("total_duration"), "request_tokens",
        F.round("request_tokens_cost", 7).alias("request_tokens_cost"))


@query("run_lines", MERGED_SQL)
def run_lines_written_and_read(t):
    path = work_path(t.spark)
    run_files.write_run_files(runs.run_documents(run_evals(t), ["run_day"]), path)
    return _merged(run_files.read_run_lines(t.spark, path))


@query("run_files", MERGED_SQL)
def run_files_written_and_read(t):
    """A file per run document, and one that is none and is told apart."""
    path = work_path(t.spark)
    documents = written(runs.run_documents(run_evals(t), ["run_day"]))
    key = F.sha2(F.to_json(F.struct(*documents.columns)), 256)
    documents.withColumn("file", key).repartition("file").write.partitionBy("file").json(path)
    t.region.limit(1).selectExpr("'{\"task\": ' AS value", "'broken' AS file").write.mode("append").partitionBy("file").option("pathExtension", "json").text(path)
    good, bad = run_files.read_run_files(t.spark, f"{path}/*")
    return _merged(good)


@query("report_store", f"""
    SELECT source, dataset, status, COUNT(*) AS n, ROUND(CAST(SUM(CAST(duration AS DECIMAL(18, 3))) AS DOUBLE), 3) AS seconds
    FROM ({CASES_SQL}), (VALUES ('local'), ('ci')) v(source) GROUP BY ALL""")
def reports_appended_and_read(t):
    """Two runs over the same evals, children found by the ids that appending returned."""
    store, out = work_path(t.spark), None
    evals = run_evals(t).select("dataset", "database", "name", "question", "duration", "status", F.lit("{}").alias("details"))
    times = t.events.agg(F.min("ts").cast("timestamp").alias("start_time"), F.max("ts").cast("timestamp").alias("end_time"))
    for source in ("local", "ci"):
        run = times.select(F.lit(source).alias("source"), "*", F.lit("text_to_sql").alias("task"), F.lit("{}").alias("scores"), F.lit("{}").alias("details"))
        run_files.append_report(run, evals, store)
    stored, children = run_files.read_report(t.spark, store)
    return children.join(stored.select(c("id").alias("run_id"), "source"), "run_id").groupBy("source", "dataset", "status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("duration").cast("double"), 3).alias("seconds"))


@query("table_metadata", """
    SELECT n_name AS table, s_name AS column, 'VARCHAR' AS data_type, 'Supplier ' || s_suppkey || ' of ' || n_name AS description
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def metadata_written_and_read(t):
    """Nations as tables, their suppliers as described columns, a JSON document for up to BLOCK of them each."""
    path = work_path(t.spark)
    one = F.struct(c("s_name").alias("column_name"), F.lit("VARCHAR").alias("data_type"),
                   F.concat(F.lit("Supplier "), "s_suppkey", F.lit(" of "), "n_name").alias("column_description"))
    tables = in_blocks(t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")), "n_name", "s_suppkey").groupBy("n_name", "block").agg(
        F.collect_list(one).alias("columns"))
    tables.select(F.to_json(F.struct(F.map_from_arrays(F.array("n_name"), F.array("columns")).alias("table_metadata"))).alias("value")) \
        .withColumn("file", F.sha2("value", 256)).write.partitionBy("file").text(path)
    return catalog.read_table_metadata(t.spark, f"{path}/*")


@query("loaded_database", """
    SELECT o_orderstatus, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def database_loaded_and_queried(t):
    """Two tables loaded in full, once over an older load, registered by name and queried in SQL."""
    path = work_path(t.spark)
    databases.replace_table(t.region, path, "loaded_orders")
    databases.replace_table(t.orders, path, "loaded_orders")
    databases.replace_table(t.lineitem, path, "loaded_lines")
    databases.register_database(t.spark, path)
    return t.spark.sql("""
        SELECT o_orderstatus, COUNT(*) AS n, SUM(l_quantity) AS quantity
        FROM loaded_orders JOIN loaded_lines ON o_orderkey = l_orderkey GROUP BY o_orderstatus""")


@query("equal_frames", """
    SELECT 'renamed' AS pair, true AS equal UNION ALL SELECT 'one more row', false UNION ALL SELECT 'one column less', false""")
def frames_compared(t):
    """Orders per customer and status: reordered, with a row more, and with a column too few."""
    expected = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    renamed = expected.select(c("n").alias("x"), c("o_orderstatus").alias("y"), c("o_custkey").alias("z"))
    pairs = [("renamed", renamed), ("one more row", renamed.union(renamed.orderBy("z", "y").limit(1))), ("one column less", renamed.drop("y"))]
    return t.spark.createDataFrame([(name, frames_equal(actual, expected)) for name, actual in pairs], "pair string, equal boolean")


@query("case_documents", f"""
    SELECT name, '{{"status":"' || status || '","tokens":' || k || CASE WHEN status <> 'error' THEN ',"more":[' || (k + 3) || ']' ELSE ',"more":[]' END || '}}' AS document
    FROM ({USAGE_SQL})""")
def documents_without_nans(t):
    """Case records as JSON; not-a-number values are left out at any depth."""
    nan = F.lit(float("nan"))
    records = run_evals(t).select("name", "status", c("cached_tokens").alias("tokens"), F.when(c("status") == "error", nan).alias("ratio"),
                                  F.when(c("status") == "error", F.array().cast("array<bigint>")).otherwise(F.array("response_tokens")).alias("more"))
    return run_files.case_documents(records.na.drop(subset=["name"]), ["name"])
