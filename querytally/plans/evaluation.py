"""Evaluation jobs over cases, results, runs and reports.

The given tables stand in for evaluation records: an event is a case, its type
the outcome, its value the duration; a customer's orders are a result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.temporal import iso_timestamp
from ..functions.table_names import referenced_tables
from ..functions.text import embedding_with_provider, split_key, split_table_name, with_provider
from ..operators import corpus, runs, scoring
from ..operators.compare import _parts, compare_results
from ..operators.results import ACTUAL, EXPECTED, result_columns
from ..session import written
from .registry import query

c = F.col

# Stand-in error classes, picked by user; size of a grouping task.
ERRORS = ("AgentFnError", "QueryExecutionError", "TimeoutError")
LINES = 2_000_000  # order lines of a task that groups them

CASES_SQL = """
  SELECT 'd' || (user_id % 4) AS dataset, 'db' || (user_id % 7) AS database,
         LPAD(CAST(event_id AS VARCHAR), 12, '0') AS name, event_id, user_id, ts, CAST(ts AS DATE) AS run_day,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'fail' ELSE 'pass' END AS status,
         value AS duration, CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CASE WHEN event_type = 'error' THEN ['AgentFnError', 'QueryExecutionError', 'TimeoutError'][1 + user_id % 3] END AS exception_class
  FROM events WHERE event_type <> 'signup'"""


def outcomes(t):
    """Outcome of every event's case; a sign-up's expected query has failed."""
    kind = c("event_type")
    return t.events.select(
        F.concat(F.lit("d"), c("user_id") % 4).alias("dataset"), F.concat(F.lit("db"), c("user_id") % 7).alias("database"),
        F.lpad(c("event_id").cast("string"), 12, "0").alias("name"), "event_id", "user_id", "ts",
        F.to_date("ts").alias("run_day"), F.when(kind == "signup", F.lit("no such table")).alias("golden_error"),
        F.when(kind == "error", F.get(F.array(*[F.lit(e) for e in ERRORS]), (c("user_id") % 3).cast("int")))
        .alias("exception_class"),
        kind.isin("purchase", "view").alias("passed"), c("value").alias("duration"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def cases(t):
    return scoring.scored(outcomes(t).withColumn("candidate_error", c("exception_class"))).drop("candidate_error")


def priced(t):
    """Token counts and their cost; the price list is the nation table."""
    tokens = cases(t).select(
        "*", F.lit("acme").alias("provider"), F.concat(F.lit("NATION_"), c("user_id") % 30).alias("model"),
        c("k").alias("cached_tokens"), (c("k") * 10).alias("request_tokens"),
        F.when(c("status") != "error", c("k") + 3).alias("response_tokens"))
    per = c("n_nationkey") / F.lit(1e6)
    prices = t.nation.select(
        F.when(c("n_regionkey") == 1, F.concat(F.lit("acme/"), c("n_name"))).otherwise(c("n_name")).alias("model"),
        per.alias("cached"), (per * 2).alias("input"), (per * 4).alias("output"))
    return scoring.with_costs(tokens, prices)


USAGE_SQL = f"""
  SELECT z.*, k AS cached_tokens, k * 10 AS request_tokens, CASE WHEN status <> 'error' THEN k + 3 END AS response_tokens,
         COALESCE(k * (n_nationkey / 1e6), 0.0) AS cached_tokens_cost,
         COALESCE(k * 10 * ((n_nationkey / 1e6) * 2), 0.0) AS request_tokens_cost,
         COALESCE(COALESCE(CASE WHEN status <> 'error' THEN k + 3 END, 0) * ((n_nationkey / 1e6) * 4), 0.0) AS response_tokens_cost
  FROM ({CASES_SQL}) z LEFT JOIN nation ON n_name = 'NATION_' || (user_id % 30)"""
USAGE_SUMS = ", ".join(
    f"CAST(SUM({f}) AS BIGINT) AS {f}, ROUND(SUM({f}_cost), 8) AS {f}_cost"
    for f in ("cached_tokens", "request_tokens", "response_tokens"))
FIGURES = """COUNT(*) FILTER (WHERE status = 'pass') AS passing, COUNT(*) AS total,
    COUNT(*) FILTER (WHERE status = 'fail') AS failed, COUNT(*) FILTER (WHERE status = 'error') AS errored,
    ROUND(SUM(duration), 3) AS total_duration,
    ROUND_EVEN(COUNT(*) FILTER (WHERE status = 'pass') / COUNT(*), 2) AS ratio"""


@query("sample_even_50", f"""
    SELECT dataset, name FROM (
      SELECT dataset, name, ROW_NUMBER() OVER (PARTITION BY dataset ORDER BY name) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY dataset) AS n FROM ({CASES_SQL})) s
    WHERE n <= 50 OR EXISTS (SELECT 1 FROM RANGE(50) r(i) WHERE CAST(ROUND_EVEN(r.i * ((n - 1) / 49.0::DOUBLE), 0) AS BIGINT) = pos)""")
def sample_even_50(t):
    return corpus.sample_evenly(cases(t).select("dataset", "name"), "dataset", ["name"])


@query("corpus_filter", f"""
    SELECT dataset, database, name FROM ({CASES_SQL}) WHERE dataset = 'd1' AND database = 'db3'""")
def corpus_filter(t):
    return corpus.select_cases(cases(t), dataset="d1", database="db3").select("dataset", "database", "name")


@query("prefix_match", f"""
    SELECT dataset, database, COUNT(*) AS n FROM ({CASES_SQL}) z
    JOIN (VALUES ('d1'), ('d1_db2'), ('d3_db5')) f(p) ON STARTS_WITH(dataset || '_' || database, p)
    GROUP BY dataset, database""")
def prefix_match(t):
    """The repeating mode: an entry counts once per prefix it matches."""
    hits = corpus.prefix_match(cases(t), ["d1", " d1_db2", "d3_db5 "], faithful=True)
    return hits.groupBy("dataset", "database").agg(F.count(F.lit(1)).alias("n"))


@query("prune_orphans", f"""
    SELECT z.dataset, z.database, name, EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.value > 150
        AND 'd' || (e.user_id % 4) = z.dataset AND 'db' || (e.user_id % 7) = z.database) AS kept
    FROM ({CASES_SQL}) z""")
def prune_orphans(t):
    """A database counts as present when it saw a large purchase."""
    known = (
        t.events.filter("event_type = 'purchase' and value > 150")
        .select(F.concat(F.lit("d"), c("user_id") % 4).alias("dataset"), F.concat(F.lit("db"), c("user_id") % 7).alias("database"))
        .distinct())
    all_cases = cases(t).select("dataset", "database", "name")
    return corpus.prune_orphans(all_cases, known).withColumn("kept", F.lit(True)).unionByName(
        corpus.orphans(all_cases, known).withColumn("kept", F.lit(False)))


@query("renumber_cases", """
    SELECT file_no, key, LPAD(CAST(n AS VARCHAR), CAST(LENGTH(CAST(MAX(n) OVER () AS VARCHAR)) AS INTEGER), '0') AS name FROM (
      SELECT file_no, key, ROW_NUMBER() OVER (ORDER BY file_no, key) AS n FROM (
        SELECT 0 AS file_no, o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT 2, event_id FROM events) u) s""")
def renumber_cases(t):
    """Question files appended in a fixed order, then numbered anew."""
    files = [t.orders.filter(c("o_orderstatus") == s).select(c("o_orderkey").alias("key")) for s in ("F", "O")]
    files.append(t.events.select(c("event_id").alias("key")))
    return corpus.renumber(corpus.append_in_order(*files), ["file_no", "key"]).select("file_no", "key", "name")


def question_queries(t):
    """A query text and a predicted table list per event; four ways to name the same tables."""
    log, user = F.concat(F.lit("Log."), c("event_type")), F.concat(F.lit('"User_'), c("user_id") % 10, F.lit('"'))

    def where_spent(text):
        return F.when(c("value") > 50, F.lit(text)).otherwise(F.lit(""))

    joined = F.concat(
        F.lit("SELECT EXTRACT(DAY FROM e.ts), 'from nowhere' FROM "), log, F.lit(" AS e JOIN "), user,
        F.lit(" u ON e.id = u.id WHERE u.id IN (SELECT id FROM (SELECT id FROM Vip"), where_spent(" JOIN Spend ON 1 = 1"), F.lit(") v)"))
    named = F.concat(
        F.lit("WITH s(n) AS (SELECT e.id FROM "), log, F.lit(" e), \"User\" AS (TABLE s) SELECT $q$ FROM hidden, x $q$ FROM (SELECT n FROM s) t, "),
        user, F.lit(" u, \"User\", Vip"), where_spent(", Spend"))
    grouped = F.concat(
        F.lit("SELECT 1 FROM (("), log, F.lit(" e JOIN Vip USING (id)) CROSS JOIN LATERAL unnest(e.xs) AS x(y)), generate_series(1, 3) g, ONLY "),
        user, F.lit(" WHERE substring(x.y FROM 2) IS NOT DISTINCT FROM g"), where_spent(" AND g IN (TABLE Spend)"))
    nested = F.concat(
        F.lit("(SELECT a FROM "), log, F.lit(" UNION SELECT b FROM "), user,
        F.lit(") EXCEPT (WITH RECURSIVE w AS (SELECT 1 UNION ALL SELECT id FROM w, Vip) SELECT * FROM w /* , a /* JOIN b */ , c */"),
        where_spent(", Spend"), F.lit(" -- , d\n)"))
    text = F.get(F.array(joined, named, grouped, nested), (c("event_id") % 4).cast("int"))
    predicted = F.concat(
        F.array(F.concat(F.lit("log."), c("event_type")), F.concat(F.lit("user_"), c("user_id") % 9)),
        F.when(c("value") > 20, F.array(F.lit("vip"), F.lit("spend"))).otherwise(F.array(F.lit("vip"))))
    return t.events.select("event_id", text.alias("query"), predicted.alias("predicted"))


@query("ref_tables", """
    SELECT event_id, 'log.' || event_type || ',' || CASE WHEN value > 50 THEN 'spend,' ELSE '' END || 'user_' || (user_id % 10) || ',vip' AS tables,
           'log' AS schema_name, event_type AS table_name FROM events""")
def ref_tables(t):
    named = question_queries(t).select("event_id", F.array_sort(referenced_tables("query")).alias("names"))
    return named.select("event_id", F.array_join("names", ",").alias("tables"), c("names")[0].alias("first")).select(
        "event_id", "tables", split_table_name("first", 0).alias("schema_name"), split_table_name("first", 1).alias("table_name"))


@query("table_set_score", """
    WITH s AS (SELECT event_id, ['log.' || event_type, 'user_' || (user_id % 10), 'vip'] || CASE WHEN value > 50 THEN ['spend'] ELSE [] END AS e,
        ['log.' || event_type, 'user_' || (user_id % 9), 'vip'] || CASE WHEN value > 20 THEN ['spend'] ELSE [] END AS a FROM events)
    SELECT event_id, LIST_HAS_ALL(a, e) AS covered, LIST_HAS_ALL(a, e) AND LIST_HAS_ALL(e, a) AS exact FROM s""")
def table_set_score(t):
    loose = scoring.score_tables(scoring.with_expected_tables(question_queries(t))).withColumnRenamed("status", "loose")
    return scoring.score_tables(loose, strict=True).select(
        "event_id", (c("loose") == "pass").alias("covered"), (c("status") == "pass").alias("exact"))


def order_results(t, float_total=False, repeat=False):
    """Two routes to a customer's order lines, as results of one case each.

    Expected: orders that have lines. Actual: every order, other column order,
    names and one column more. They agree where no order is without lines.

    A read task may have lines of any number of orders, so the lines go to tasks by order, a bounded number to a
    task, before they are grouped; the grouping then needs no further shuffle.
    """
    parts = _parts(t.lineitem, t.lineitem.count(), LINES)
    lines = t.lineitem.repartition(parts, "l_orderkey", *["l_partkey"] * repeat).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("l_partkey") if repeat else F.lit(0)).alias("parts"),
        F.sum("l_extendedprice").alias("total"), (F.avg("l_extendedprice") * F.count(F.lit(1))).alias("again"))
    orders = t.orders if repeat else t.orders.repartition(parts, "o_orderkey")
    full = orders.join(lines, c("o_orderkey") == c("l_orderkey"), "left").na.fill(0, ["n", "parts"]).na.fill(0.0, ["total", "again"])
    e_cols, a_cols = ["o_orderkey", "n", "o_orderpriority"], ["o_orderpriority", "n", "o_totalprice", "o_orderkey"]
    if float_total:
        e_cols, a_cols = [*e_cols, "total"], ["again", *a_cols]
    if repeat:
        e_cols, a_cols = [*e_cols, "parts"], ["parts", *a_cols]
    key = {"c_custkey": c("o_custkey")}
    actual, expected = (F.struct(*result_columns(full, key, side, cols, c("o_orderkey"))) for side, cols in ((ACTUAL, a_cols), (EXPECTED, e_cols)))
    # results are kept before they are compared, as a run of the queries would; both sides come from one join
    rows = written(full.select(F.explode(F.array(actual, F.when(c("l_orderkey").isNotNull(), expected))).alias("r")).filter("r IS NOT NULL").select("r.*"))
    kinds = {"o_orderkey": "i", "n": "i", "parts": "i", "o_orderpriority": "s", "o_totalprice": "f", "total": "f", "again": "f"}
    who = t.orders.select(c("o_custkey").alias("c_custkey")).distinct()
    headers = who.select("c_custkey", F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.lit("".join(kinds[x] for x in cols)).alias("kinds"))
        for side, cols in ((ACTUAL, a_cols), (EXPECTED, e_cols))])).alias("h")).select("c_custkey", "h.*")
    return headers, rows


ALL_SHIPPED_SQL = """SELECT o_custkey AS c_custkey, BOOL_AND(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS {0}
    FROM orders GROUP BY o_custkey"""


@query("compare_results", ALL_SHIPPED_SQL.format("passed"))
def compare_results_query(t):
    headers, rows = order_results(t)
    return compare_results(headers, rows, ["c_custkey"])


@query("compare_results_hashed", ALL_SHIPPED_SQL.format("passed"))
def compare_results_hashed(t):
    headers, rows = order_results(t)
    return compare_results(headers, rows, ["c_custkey"], exact=False)


@query("compare_results_tolerant", ALL_SHIPPED_SQL.format("passed"))
def compare_results_tolerant(t):
    """A float column reached by two sums, equal only within the tolerance."""
    headers, rows = order_results(t, float_total=True)
    return compare_results(headers, rows, ["c_custkey"])


@query("compare_results_repeated", ALL_SHIPPED_SQL.format("passed"))
def compare_results_repeated(t):
    """Two expected columns that are often equal; one-to-one matching."""
    headers, rows = order_results(t, repeat=True)
    return compare_results(headers, rows, ["c_custkey"])


@query("compare_results_faithful", """
    WITH lines AS (SELECT l_orderkey, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_orderkey),
    f AS (SELECT o_custkey, BOOL_AND(l_orderkey IS NOT NULL) AS shipped, LIST(n ORDER BY n) AS ns,
            LIST(parts ORDER BY parts) AS ps, LIST(o_orderkey ORDER BY o_orderkey) AS ks
          FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY o_custkey)
    SELECT o_custkey AS c_custkey, shipped AND ns <> ps AND ns <> ks AND ps <> ks AS passed FROM f""")
def compare_results_faithful(t):
    """The overwriting mode: equal columns lose one and fail."""
    headers, rows = order_results(t, repeat=True)
    return compare_results(headers, rows, ["c_custkey"], faithful=True)


@query("status_rollup", f"SELECT dataset, {FIGURES} FROM ({CASES_SQL}) GROUP BY dataset")
def status_rollup(t):
    return scoring.dataset_rollup(cases(t))


@query("overall_rollup", f"""
    SELECT CASE WHEN GROUPING(dataset) = 1 THEN 'overall' ELSE 'dataset' END AS level, dataset, {FIGURES}
    FROM ({CASES_SQL}) GROUP BY ROLLUP (dataset)""")
def overall_rollup(t):
    return scoring.overall_rollup(cases(t))


@query("error_histogram", f"""
    SELECT dataset, exception_class, COUNT(*) AS n FROM ({CASES_SQL}) WHERE status = 'error' GROUP BY ALL""")
def error_histogram(t):
    return scoring.error_histogram(cases(t))


@query("error_histogram_map", f"""
    SELECT dataset, '{{' || STRING_AGG('"' || exception_class || '":' || n, ',' ORDER BY exception_class) || '}}' AS counts FROM (
      SELECT dataset, exception_class, COUNT(*) AS n FROM ({CASES_SQL}) WHERE status = 'error' GROUP BY ALL) s GROUP BY dataset""")
def error_histogram_map(t):
    return scoring.histogram_map(scoring.error_histogram(cases(t))).select(
        "dataset", F.to_json("failed_error_counts").alias("counts"))


@query("usage_cost", f"SELECT dataset, {USAGE_SUMS} FROM ({USAGE_SQL}) GROUP BY dataset")
def usage_cost(t):
    return priced(t).groupBy("dataset").agg(*scoring.usage_sums())


@query("case_costs", f"""
    SELECT event_id, ROUND(cached_tokens_cost, 9) AS cached_tokens_cost, ROUND(request_tokens_cost, 9) AS request_tokens_cost,
           ROUND(response_tokens_cost, 9) AS response_tokens_cost FROM ({USAGE_SQL})""")
def case_costs(t):
    return priced(t).select("event_id", *[F.round(f"{f}_cost", 9).alias(f"{f}_cost") for f in scoring.COUNTERS])


@query("provider_keys", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'openai:o3' WHEN p_size % 3 = 1 THEN 'mistral:codestral-latest' ELSE p_name END AS task_model,
           CASE WHEN p_size % 2 = 0 THEN 'ollama:smollm:135m' ELSE 'sentence_transformers:nomic-ai/' || p_name END AS embedding_model,
           CASE WHEN p_size % 2 = 0 THEN 'ollama' ELSE 'sentence_transformers' END AS provider,
           CASE WHEN p_size % 2 = 0 THEN 'smollm:135m' ELSE 'nomic-ai/' || p_name END AS model FROM part""")
def provider_keys(t):
    size = c("p_size")
    bare = F.when(size % 3 == 0, "o3").when(size % 3 == 1, "codestral-latest").otherwise(c("p_name"))
    embed = F.when(size % 2 == 0, F.lit("smollm:135m")).otherwise(F.concat(F.lit("nomic-ai/"), "p_name"))
    keyed = t.part.select("p_partkey", with_provider(bare).alias("task_model"),
                          embedding_with_provider(embed).alias("embedding_model"))
    return keyed.select("*", split_key("embedding_model", 0).alias("provider"), split_key("embedding_model", 1).alias("model"))


def run_evals(t):
    return priced(t).withColumn("question", F.concat(F.lit("Question "), c("name")))


@query("merge_runs", f"""
    SELECT 'dataset' AS level, dataset, COUNT(*) FILTER (WHERE status = 'pass') AS passing, COUNT(*) AS total,
           ROUND(SUM(duration), 2) AS total_duration, CAST(SUM(request_tokens) AS BIGINT) AS request_tokens,
           ROUND(SUM(request_tokens_cost), 7) AS request_tokens_cost,
           ROUND_EVEN(COUNT(*) FILTER (WHERE status = 'pass') / COUNT(*), 2) AS ratio
    FROM ({USAGE_SQL}) GROUP BY dataset
    UNION ALL
    SELECT 'overall', NULL, COUNT(*) FILTER (WHERE status = 'pass'), COUNT(*), ROUND(SUM(duration), 2),
           CAST(SUM(request_tokens) AS BIGINT), ROUND(SUM(request_tokens_cost), 7),
           ROUND_EVEN(COUNT(*) FILTER (WHERE status = 'pass') / COUNT(*), 2) FROM ({USAGE_SQL})""")
def merge_runs(t):
    """Run files per day and data set, merged into one report."""
    files = runs.run_documents(run_evals(t), ["run_day"])
    return runs.with_overall(runs.merged_totals(files)).select(
        "level", "dataset", "passing", "total", F.round("total_duration", 2).alias("total_duration"), "request_tokens",
        F.round("request_tokens_cost", 7).alias("request_tokens_cost"), "ratio")


@query("merge_run_lists", f"""
    SELECT dataset, 'failed' AS list, name, NULL AS n FROM ({CASES_SQL}) WHERE status = 'fail'
    UNION ALL SELECT dataset, 'errored', name, NULL FROM ({CASES_SQL}) WHERE status = 'error'
    UNION ALL SELECT dataset, 'counts', exception_class, COUNT(*) FROM ({CASES_SQL}) WHERE status = 'error' GROUP BY 1, 2, 3
    UNION ALL SELECT dataset, 'evals', status, COUNT(*) FROM ({CASES_SQL}) GROUP BY 1, 2, 3""")
def merge_run_lists(t):
    files = written(runs.run_documents(run_evals(t), ["run_day"]))
    nothing = F.lit(None).cast("long").alias("n")
    out = runs.merged_error_counts(files).select("dataset", F.lit("counts").alias("list"), c("exception_class").alias("name"), "n")
    for which in ("failed", "errored"):
        out = out.unionByName(runs.merged_names(files, which).select("dataset", F.lit(which).alias("list"), "name", nothing))
    return out.unionByName(
        runs.merged_evals(files).groupBy("dataset", c("status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("list", F.lit("evals")))


RUNS_SQL = f"""SELECT run_day, MIN(ts) AS start_time, MAX(ts) AS end_time, COUNT(*) AS n FROM ({CASES_SQL}) GROUP BY run_day"""


def run_rows(t):
    return cases(t).groupBy("run_day").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("n"))


@query("run_span", f"SELECT MIN(start_time) AS start_time, MAX(end_time) AS end_time FROM ({RUNS_SQL})")
def run_span(t):
    return runs.run_span(run_rows(t))


@query("newest_runs", f"SELECT run_day AS id, start_time, n FROM ({RUNS_SQL}) ORDER BY start_time DESC")
def newest_runs(t):
    return runs.newest_first(run_rows(t).withColumnRenamed("run_day", "id")).select("id", "start_time", "n")


@query("run_children", f"""
    SELECT r.run_day AS run_id, source, start_time, name, status FROM ({CASES_SQL}) z
    JOIN (SELECT run_day, MIN(ts) AS start_time, 'local' AS source FROM ({CASES_SQL}) GROUP BY run_day) r ON r.run_day = z.run_day""")
def run_children(t):
    parents = run_rows(t).select(c("run_day").alias("id"), F.lit("local").alias("source"), "start_time")
    children = cases(t).select(c("run_day").alias("run_id"), "name", "status")
    return runs.run_evals(parents, children)


@query("timing_stats", f"""
    WITH s AS (SELECT dataset, COUNT(*) AS total, ROUND(AVG(duration), 5) AS avg_time, ROUND(MAX(duration), 5) AS max_time,
                 ROUND(MIN(duration), 5) AS min_time FROM ({CASES_SQL}) GROUP BY dataset)
    SELECT * FROM s UNION ALL
    SELECT 'all', CAST(SUM(total) AS BIGINT), ROUND(AVG(avg_time), 6), MAX(max_time), MIN(min_time) FROM s""")
def timing_stats(t):
    stats = scoring.timing_stats(cases(t), "duration")
    return stats.unionByName(scoring.overall_timing(stats).select(
        F.lit("all").alias("dataset"), "total", F.round("avg_time", 6).alias("avg_time"), "max_time", "min_time"))


@query("score_json", f"""
    SELECT run_day, '{{' || STRING_AGG('"' || dataset || '":{{"passing":' || p || ',"total":' || n || '}}', ',' ORDER BY dataset) || '}}' AS scores
    FROM (SELECT run_day, dataset, COUNT(*) FILTER (WHERE status = 'pass') AS p, COUNT(*) AS n FROM ({CASES_SQL}) GROUP BY ALL) s
    GROUP BY run_day""")
def score_json(t):
    figures = cases(t).groupBy("run_day", "dataset").agg(
        F.count_if(c("status") == "pass").alias("passing"), F.count(F.lit(1)).alias("total"))
    return scoring.score_map(figures, ["run_day"])


@query("sorted_lists", f"""
    SELECT dataset, status, (r - 1) // 1000 AS piece, STRING_AGG(name, ',' ORDER BY name) AS names FROM (
      SELECT dataset, status, name, ROW_NUMBER() OVER (PARTITION BY dataset, status ORDER BY name) AS r
      FROM ({CASES_SQL}) WHERE status <> 'pass') s GROUP BY ALL""")
def sorted_lists(t):
    """Failed and errored names in order, in pieces of a thousand."""
    rest = cases(t).filter("status <> 'pass'")
    return scoring.name_lists(rest, ["dataset", "status"]).select(
        "dataset", "status", "piece", F.array_join("names", ",").alias("names"))


REVIEW_SQL = """
    WITH lines AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey),
    f AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, COALESCE(n, 0) AS n, l_orderkey IS NOT NULL AS shipped
          FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
    bad AS (SELECT o_custkey FROM f GROUP BY o_custkey HAVING NOT BOOL_AND(shipped)),
    e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM f WHERE shipped),
    a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM f),
    ex AS (SELECT o_custkey, STRING_AGG(o_orderkey || ' | ' || n || ' | ' || o_orderpriority, CHR(10) ORDER BY r) AS x FROM e WHERE r <= 10 GROUP BY 1),
    ax AS (SELECT o_custkey, STRING_AGG(o_orderpriority || ' | ' || n || ' | ' || o_orderkey, CHR(10) ORDER BY r) AS x FROM a WHERE r <= 10 GROUP BY 1)
    SELECT b.o_custkey AS c_custkey, 'Question: Orders of ' || b.o_custkey || CHR(10) || CHR(10) || 'Expected query:' || CHR(10) || 'inner' || CHR(10) || CHR(10)
      || 'Expected rows:' || CHR(10) || 'key | lines | priority' || COALESCE(CHR(10) || ex.x, '') || CHR(10) || CHR(10) || 'Actual query:' || CHR(10) || 'outer' || CHR(10) || CHR(10)
      || 'Actual rows:' || CHR(10) || 'priority | lines | order' || COALESCE(CHR(10) || ax.x, '') AS review
    FROM bad b LEFT JOIN ex ON ex.o_custkey = b.o_custkey LEFT JOIN ax ON ax.o_custkey = b.o_custkey"""


@query("review_sample", REVIEW_SQL)
def review_sample(t):
    """Failed comparisons with the first ten rows of either side."""
    headers, rows = order_results(t)
    outcome = compare_results(headers, rows, ["c_custkey"]).withColumn(
        "status", F.when(c("passed"), "pass").otherwise("fail"))
    failed = corpus.review_candidates(outcome, "fail").select(  # the verdicts are stored
        "c_custkey", F.concat(F.lit("Orders of "), c("c_custkey")).alias("question"),
        F.lit("inner").alias("expected_query"), F.lit("outer").alias("generated_query"))
    shown = rows.withColumn("cells", F.when(c("side") == ACTUAL, F.array(
        c("cells")[0], c("cells")[1], c("cells")[3])).otherwise(c("cells")))
    headings = failed.select("c_custkey", F.explode(F.array(
        F.struct(F.lit(EXPECTED).alias("side"), F.array(*map(F.lit, ("key", "lines", "priority"))).alias("names")),
        F.struct(F.lit(ACTUAL).alias("side"), F.array(*map(F.lit, ("priority", "lines", "order"))).alias("names")))).alias("h")).select("c_custkey", "h.*")
    return scoring.review_sample(failed, shown, ["c_custkey"], headers=headings).select("c_custkey", "review")


@query("golden_validation", """
    SELECT o_orderpriority AS dataset, o_orderkey AS name,
           CASE WHEN o_orderstatus = 'P' AND o_totalprice > 480000 THEN 'Failed to execute query: too large'
                WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'No results' END AS problem,
           (o_orderstatus = 'P' AND o_totalprice > 480000) OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS flagged
    FROM orders""")
def golden_validation(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    outcome = t.orders.join(lines, c("o_orderkey") == c("l_orderkey"), "left").select(
        c("o_orderpriority").alias("dataset"), c("o_orderkey").alias("name"), F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.when((c("o_orderstatus") == "P") & (c("o_totalprice") > 480000), F.lit("too large")).alias("error"))
    return scoring.golden_validation(outcome).select("dataset", "name", "problem", "flagged")


@query("case_record", f"""
    SELECT name, question, status, exception_class, duration, expected_query, tables, request_tokens, cost FROM (
      SELECT name, 'Question ' || name AS question, status, exception_class, duration,
        'select ' || event_id AS expected_query, 'orders' AS tables, request_tokens, ROUND(request_tokens_cost, 9) AS cost
      FROM ({USAGE_SQL})) s""")
def case_record(t):
    full = run_evals(t).select(
        "*", F.concat(F.lit("select "), c("event_id")).alias("expected_query"),
        F.concat(F.lit("select * from t"), c("event_id")).alias("generated_query"), F.array(F.lit("orders")).alias("gold_tables"))
    outcome = full.filter("status <> 'error'").select("name", (c("status") == "pass").alias("passed"))
    record = scoring.case_record(full.drop("status"), outcome, ["name"])
    return record.select("name", "question", "status", "details.exception_class", "duration", "details.expected_query",
                         F.array_join("details.gold_tables", ",").alias("tables"), "details.usage.request_tokens",
                         F.round("details.usage.request_tokens_cost", 9).alias("cost"))


@query("iso_times", "SELECT event_id, EPOCH_US(ts) AS micros FROM events")
def iso_times(t):
    """Times written as ISO-8601 with an offset and read back."""
    text = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return t.events.select("event_id", F.unix_micros(iso_timestamp(text)).alias("micros"))


@query("json_details", """
    SELECT event_id, '{"type":"' || event_type || '","usage":{"tokens":' || REGEXP_EXTRACT(props, '([0-9]+)', 1) || '}}' AS details,
           CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) AS tokens FROM events""")
def json_details(t):
    k = F.from_json("props", "k long")["k"]
    text = F.to_json(F.struct(c("event_type").alias("type"), F.struct(k.alias("tokens")).alias("usage")))
    return t.events.select("event_id", text.alias("details")).select(
        "*", F.from_json("details", "type string, usage struct<tokens: long>")["usage"]["tokens"].alias("tokens"))
