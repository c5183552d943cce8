"""Write and read back; one unreadable file; execution end to end."""

import decimal
import json
import os

import pytest
from pyspark.sql import functions as F

from querytally.operators import execute, runs, scoring
from querytally.operators.assemble import table_texts
from querytally.session import table
from querytally.sources import cases, catalog, databases, lines, runs as run_store


def put(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


@pytest.fixture()
def root(tmp_path):
    r = str(tmp_path)
    for dataset, name, db in (("alpha", "001", "geo"), ("alpha", "002", "gone"), ("beta", "1", "shop")):
        put(f"{r}/{dataset}/evals/{name}/eval.json", json.dumps(
            {"database": db, "question": f"how\nmany {name}?", "query": "SELECT 1"}, indent=2))
    put(f"{r}/alpha/databases/geo.sql", "x")
    put(f"{r}/alpha/databases/cards.part000.sql", "x")
    put(f"{r}/alpha/databases/cards.part001.sql", "x")
    put(f"{r}/alpha/databases/readme.txt", "x")
    put(f"{r}/beta/databases.json", '["shop",\n "air"]')
    put(f"{r}/beta/databases/ignored.sql", "x")
    put(f"{r}/none/databases.json", "[]")
    put(f"{r}/none/databases/undeclared.sql", "x")
    return r


def test_read_cases(spark, root):
    got = {(r.dataset, r.name, r.database) for r in cases.read_cases(spark, root).collect()}
    assert got == {("alpha", "001", "geo"), ("alpha", "002", "gone"), ("beta", "1", "shop")}


def test_discover_databases(spark, root):
    got = {(r.dataset, r.database) for r in databases.discover_databases(spark, root).collect()}
    assert got == {("alpha", "geo"), ("alpha", "cards"), ("beta", "shop"), ("beta", "air")}


def test_questions_to_cases(spark, tmp_path):
    paths = []
    for i, n in enumerate((3, 9)):
        p = f"{tmp_path}/q{i}.json"
        put(p, json.dumps([{"db_id": "gone" if k == 1 else "geo", "question": f"q{i}{k}", "query": f'select "{k}"'} for k in range(n)]))
        paths.append(p)
    known = spark.createDataFrame([("geo",)], "database string")
    built = cases.build_cases(cases.read_questions(spark, paths), "s", known)
    rows = built.orderBy("name").collect()
    assert [r.name for r in rows] == [f"{i:02d}" for i in range(1, 11)]
    assert [r.question for r in rows] == ["q00", "q02", "q10"] + [f"q1{k}" for k in range(2, 9)]
    assert rows[0].query == "select '0'"
    cases.write_cases(built, f"{tmp_path}/out")
    assert os.path.isfile(f"{tmp_path}/out/s/evals/01/eval.json")
    cases.write_cases(built.limit(4), f"{tmp_path}/out")  # in place of the first
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["s"]
    back = cases.read_cases(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, built.collect()))


def test_evidence(spark, tmp_path):
    put(f"{tmp_path}/q.json", json.dumps([{"db_id": "a", "question": "q", "evidence": "e", "SQL": "select 1"}]))
    row = cases.build_cases(cases.read_questions(spark, [f"{tmp_path}/q.json"]), "b").first()
    assert (row.question, row.query, row.name) == ("q\ne", "select 1", "1")


YAML = """---
type: header
schema_version: '1'
...
---
schema: public
name: city
type: table
description: Cities.
columns:
- name: Id
  description: Key of the city.
- name: name
  description: Its name.
...
---
type: fact
description: Cities have people.
...
---
type: sql_example
sql: select count(*) from city
description: How many?
...
"""


def test_catalog_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    put(f"{tmp_path}/c/geo.yaml", YAML)
    docs = catalog.read_documents(spark, f"{tmp_path}/c/*.yaml").cache()
    assert [r.type for r in docs.orderBy("doc_no").collect()] == ["header", "table", "fact", "sql_example"]
    assert [(r.table, r.ordinal, r.column) for r in catalog.column_docs(docs).collect()] == [("city", 0, "Id"), ("city", 1, "name")]
    assert catalog.facts(docs).first().description == "Cities have people."
    assert catalog.sql_examples(docs).first().sql == "select count(*) from city"
    city = catalog.described(spark.createDataFrame([(1, "x")], "Id int, name string"), docs, "public", "city")
    databases.replace_table(city, str(tmp_path), "city")
    databases.replace_table(city.limit(0), str(tmp_path), "city")
    back = table(spark, str(tmp_path), "city")
    assert back.count() == 0
    assert catalog.comments_of(back) == {"Id": "Key of the city.", "name": "Its name."}
    assert databases.register_database(spark, str(tmp_path)) == ["city"]
    listing = databases.list_columns(spark, ["city"])
    assert [(r.column_name, r.comment) for r in listing.collect()] == [("Id", "Key of the city."), ("name", "Its name.")]
    ddl = table_texts(listing).first().ddl
    assert ddl == "CREATE TABLE city\n(\n    Id int NULL -- Key of the city.,\n    name string NULL -- Its name.\n);\n"


def test_description_files(spark, tmp_path):
    put(f"{tmp_path}/Schools.csv", 'original,name,desc,fmt,value\n CDSCode ,x,café "id" ,int,\nzip,x,"post, code",int,5 digits \n',
        encoding="latin-1")
    put(f"{tmp_path}/m.json", json.dumps({"table_metadata": {
        "t": [{"column_name": "a", "column_description": "first", "data_type": "int"}, {"column_name": "b", "column_description": "second"}]}}))
    d = catalog.read_description_csv(spark, f"{tmp_path}/*.csv")
    got = {r.column: (r.table, r.comment) for r in d.collect()}
    assert got == {"CDSCode": ("schools", 'café "id".'), "zip": ("schools", "post, code. 5 digits.")}
    real = spark.createDataFrame([("schools", "cdscode"), ("schools", "zip"), ("schools", "none")], "table string, column string")
    found = {r.column: r.comment for r in catalog.matched_comments(real, d).collect()}
    assert found == {"cdscode": 'café "id".', "zip": "post, code. 5 digits.", "none": None}
    twice = spark.createDataFrame(
        [("t", "A", "first", 1), ("t", "A", "a later one", 2), ("t", "b", "x", 1), ("t", "B", "y", 2)], "table string, column string, comment string, ordinal int")
    real = spark.createDataFrame([("t", "A"), ("t", "b"), ("t", "a")], "table string, column string")
    found = catalog.matched_comments(real, twice).collect()
    assert sorted((r.column, r.comment) for r in found) == [("A", "a later one"), ("a", "a later one"), ("b", "x")]
    meta = catalog.read_table_metadata(spark, f"{tmp_path}/m.json").collect()
    assert [(r.table, r.column, r.description) for r in meta] == [("t", "a", "first"), ("t", "b", "second")]


def test_config(spark, tmp_path):
    catalog.save_config(spark, f"{tmp_path}/config", catalog="default")
    assert catalog.read_config(spark, f"{tmp_path}/config", "catalog") == "default"
    assert catalog.read_config(spark, f"{tmp_path}/config", "other") is None


def run_file(start, end, usage=True):
    summary = {"passing": 1, "total": 3, "total_duration": 1.5, "failed": ["b"], "errored": ["c"],
               "failed_error_counts": {"TimeoutError": 1},
               "evals": [{"status": s, "dataset": "d", "database": "x", "name": n, "question": "q", "duration": 0.5,
                          "details": {"a": [1, {"b": 2}]}} for n, s in (("a", "pass"), ("b", "fail"), ("c", "error"))]}
    if usage:
        summary["usage"] = {"cached_tokens": 1, "cached_tokens_cost": 0.5, "request_tokens": 2, "request_tokens_cost": 0.25,
                            "response_tokens": 3, "response_tokens_cost": 0.125}
    return json.dumps({"task": "text_to_sql", "start_time": start, "end_time": end, "details": {"model": "m"}, "results": {"d": summary}}, indent=1)


def test_run_files(spark, tmp_path):
    put(f"{tmp_path}/r/one.json", run_file("2024-05-01T10:00:00.5+00:00", "2024-05-01T11:00:00+00:00"))
    put(f"{tmp_path}/r/two.json", run_file("2024-05-01T11:30:00+02:00", None, usage=False))
    put(f"{tmp_path}/r/broken.json", '{"task": "text_to')
    put(f"{tmp_path}/r/notes.txt", "no run")
    good, bad = run_store.read_run_files(spark, f"{tmp_path}/r")
    assert good.count() == 2
    assert [os.path.basename(r.file) for r in bad.collect()] == ["broken.json"]
    total = runs.merged_totals(good).first()
    assert (total.passing, total.total, total.total_duration, total.request_tokens, total.cached_tokens_cost) == (2, 6, 3.0, 2, 0.5)
    assert sorted(r.name for r in runs.merged_names(good, "failed").collect()) == ["b", "b"]
    assert runs.merged_error_counts(good).first().n == 2
    span = runs.run_span(good).select(F.unix_seconds("start_time").alias("s"), F.unix_seconds("end_time").alias("e")).first()
    assert (span.s, span.e) == (1714555800, 1714561200)
    evals = runs.merged_evals(good)
    assert json.loads(evals.first().details) == {"a": [1, {"b": 2}]}

    figures = runs.merged_totals(good).withColumn("source", F.lit("local"))
    scores = scoring.score_map(figures, ["source"])
    run = runs.run_span(good).crossJoin(scores).withColumns({"task": F.lit("text_to_sql"), "details": F.lit("{}")})
    store = f"{tmp_path}/store"
    run_store.append_report(run, evals, store)
    run_store.append_report(run.withColumn("source", F.lit("ci")), evals, store)
    again = run_store.append_report(run, evals, store)  # the same run once more is a run of its own
    stored, children = run_store.read_report(spark, store)
    assert stored.select("id").distinct().count() == 3 and children.count() == 18
    assert runs.run_evals(stored, children, again).count() == 6
    first = stored.filter("source = 'ci'").first()
    assert json.loads(first.scores) == {"d": {"passing": 2, "total": 6}}
    mine = runs.run_evals(stored, children, first.id)
    assert mine.count() == 6
    assert "run_id" in mine._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert dict(children.dtypes)["duration"] == "decimal(18,3)"

    run_store.write_run_files(good.drop("file"), f"{tmp_path}/lines")
    assert runs.merged_totals(run_store.read_run_lines(spark, f"{tmp_path}/lines")).first().total == 6


def test_case_documents(spark):
    df = spark.createDataFrame(
        [("a", float("nan"), decimal.Decimal("1.10"), [1.0, float("nan")], (float("inf"), "t"))],
        "name string, x double, d decimal(10,2), xs array<double>, s struct<y: double, z: string>")
    text = run_store.case_documents(df, ["name"]).first().document
    assert "NaN" not in text and "Inf" not in text and "1.10" in text
    assert json.loads(text)["xs"] == [1.0, None]


def test_lines_and_parts(spark, tmp_path):
    from querytally.operators.dumps import part_numbers, strip_lines

    text = "\n".join(["-- head", ""] + [f"INSERT INTO t VALUES ({i}, 'x');" for i in range(5000)] + ["", "SET a;", ""])
    put(f"{tmp_path}/d/big.sql", text)
    put(f"{tmp_path}/d/small.sql", "one\n\n\ntwo\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = lines.read_lines(spark, f"{tmp_path}/d/*.sql")
        assert raw.rdd.getNumPartitions() > 5
        ordered = raw.filter("file like '%big.sql'").orderBy("line_no").collect()
        assert [r.line for r in ordered] == text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")
        clean = strip_lines(raw, chunk_rows=500)
        assert [r.line for r in clean.filter("file like '%small.sql'").orderBy("line_no").collect()] == ["one", "", "two"]
        lines.write_parts(part_numbers(clean, limit=30000, chunk_rows=5000), f"{tmp_path}/parts")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    back = spark.read.text(f"{tmp_path}/parts")
    assert back.filter("file = 'big'").count() == 5000
    sizes = back.filter("file = 'big'").groupBy("part").agg(F.sum(F.length("value") + 1).alias("n")).orderBy("part").collect()
    assert len(sizes) > 4 and max(r.n for r in sizes) <= 30000 + 40  # a statement may reach over


def test_run_document_files(spark, tmp_path):
    """Evals written as run files of bounded size and read as a report."""
    usage = [(F.lit(0.5) if u.endswith("cost") else F.lit(1)).alias(u) for u in runs.USAGE]
    evals = spark.range(25).select(
        F.lit("d").alias("dataset"), F.lit("x").alias("database"), F.lpad(F.col("id").cast("string"), 2, "0").alias("name"),
        F.lit("q").alias("question"), F.lit("fail").alias("status"), F.lit(0.1).alias("duration"),
        F.lit(None).cast("string").alias("exception_class"), *usage)
    files = runs.with_run_header(runs.run_documents(evals, [], per_file=10), "text_to_sql", "2024-01-01 10:00:00", None, {"model": "m"})
    run_store.write_run_files(files, f"{tmp_path}/r")
    back = run_store.read_run_lines(spark, f"{tmp_path}/r")
    assert back.count() == 3
    assert json.loads(back.first().details) == {"model": "m"}
    total = runs.merged_totals(back).first()
    assert (total.total, total.total_duration, total.request_tokens) == (25, 2.5, 25)
    assert sorted(r.name for r in runs.merged_names(back, "failed").collect()) == [f"{i:02d}" for i in range(25)]


def test_schema_tables_and_types(spark, tmp_path):
    text = spark.createDataFrame([("1", "ab  ", "2.50", "t", "2024-01-01 00:00:00+00", "x"), ("z", None, "bad", None, None, "y")],
                                 "id string, code string, gnp string, ok string, at string, `odd name` string")
    types = {"id": "integer", "code": "character(4)", "gnp": "numeric(10,2)", "ok": "boolean", "at": "timestamptz"}
    df = databases.typed(text, types)
    assert dict(df.dtypes) == {"id": "int", "code": "string", "gnp": "decimal(10,2)", "ok": "boolean", "at": "timestamp", "odd name": "string"}
    rows = df.orderBy(F.col("id").asc_nulls_last()).collect()
    assert (rows[0].code, rows[0].gnp, rows[0].ok) == ("ab", decimal.Decimal("2.50"), True)
    assert (rows[1].id, rows[1].gnp) == (None, None)
    assert databases.with_defaults(df).filter("code = ''").count() == 1
    databases.replace_table(df, f"{tmp_path}/air", "flight")
    assert databases.register_database(spark, f"{tmp_path}/air", "air") == ["flight"]
    assert spark.sql('SELECT "odd name" AS v FROM air.flight f WHERE f.ID = 1').first().v == "x"
    assert databases.spark_type("double precision") == "double"


def test_saved_descriptions(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS world")
    df = catalog.with_comments(spark.createDataFrame([(1, "a")], "ID int, name string"), {"id": "The city's key."})
    catalog.save_described(df, "world.city", "Cities 'n' towns.")
    assert spark.catalog.getTable("world.city").description == "Cities 'n' towns."
    listing = databases.list_columns(spark, ["city"], "world").filter("table_schema = 'world'")
    assert [(r.ordinal, r.column_name, r.comment) for r in listing.collect()] == [(1, "ID", "The city's key."), (2, "name", None)]
    spark.sql("DROP DATABASE world CASCADE")


def test_context_modes(spark):
    from querytally.operators.corpus import context_objects

    objects = spark.createDataFrame(
        [(1, "table", ["public", "a"], [1.0, 0.0]), (2, "table", ["other", "b"], [0.0, 1.0]), (3, "view", ["public", "a"], [1.0, 1.0])],
        "id long, objtype string, objnames array<string>, vector array<float>")
    wanted = spark.createDataFrame([("q", ["a", "a", "b"], [1.0, 0.1])], "query_id string, tables array<string>, vector array<float>")
    assert context_objects("entire_catalog", objects, wanted).count() == 3
    assert [r.id for r in context_objects("specific_ids", objects, wanted).collect()] == [1]
    assert [r.id for r in context_objects("semantic_search", objects, wanted, k=2, dims=2).orderBy("rank").collect()] == [1, 3]


def test_release(spark):
    from querytally.session import release_written, written

    df = written(spark.range(3))
    path = df.inputFiles()[0].replace("file://", "").replace("file:", "")
    assert df.count() == 3 and os.path.exists(path)
    release_written(spark)
    assert not os.path.exists(path)


def test_execute_and_judge(spark, tmp_path):
    d = str(tmp_path / "geo")
    spark.createDataFrame([("a", 5.0, "x"), ("b", 7.5, "y"), ("c", 7.5, None)], "state string, area double, note string").write.parquet(f"{d}/state.parquet")
    spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "state string, border string").write.parquet(f"{d}/borders.parquet")
    golden = [
        ("1", "SELECT state FROM state WHERE area = (SELECT MAX(area) FROM state);"),
        ("2", "SELECT border FROM borders WHERE state IN (SELECT border FROM borders WHERE state = 'a')"),
        ("3", "SELECT COUNT(*), AVG(area) FROM state"),
        ("4", "SELECT state FROM state ORDER BY area DESC NULLS LAST, state LIMIT 1"),
        ("5", "SELECT nothing FROM state"),
        ("6", "SELECT state, area FROM state WHERE area > 100"),
    ]
    candidate = [
        ("1", "SELECT s.state, s.area FROM state s WHERE area >= 7.5"),
        ("2", "SELECT b.border FROM borders a JOIN borders b ON a.border = b.state WHERE a.state = 'a'"),
        ("3", "SELECT SUM(area) / COUNT(*) AS m, COUNT(state) AS n FROM state"),
        ("4", "SELECT state FROM state ORDER BY area LIMIT 1"),
        ("5", "SELECT 1"),
        ("6", "SELECT state FROM missing"),
    ]
    schema = "dataset string, database string, name string, query string"
    out = str(tmp_path / "out")
    seen = []

    def prepare(dataset, database):
        seen.append(database)
        databases.register_database(spark, d)

    for side, queries in (("expected", golden), ("actual", candidate)):
        df = spark.createDataFrame([("s", "geo", n, q) for n, q in queries], schema)
        execute.run_cases(df, side, out, prepare)
    headers, rows = execute.read_outcomes(spark, out)
    assert seen == ["geo", "geo"]
    before = {(r.name, r.status) for r in execute.judged(headers, rows).collect()}
    execute.run_cases(spark.createDataFrame([("s", "geo", n, q) for n, q in candidate], schema), "actual", out, prepare)
    headers, rows = execute.read_outcomes(spark, out)
    assert headers.count() == 12 and {(r.name, r.status) for r in execute.judged(headers, rows).collect()} == before
    failed = headers.filter("side = 'actual' AND name = '6'").first()
    assert "missing" in failed.error and "Traceback" in failed.trace
    assert headers.filter("side = 'expected' and name = '6'").first().n_rows == 0
    judged = execute.judged(headers, rows)
    got = {r.name: (r.status, r.exception_class) for r in judged.collect()}
    assert got == {"1": ("pass", None), "2": ("pass", None), "3": ("pass", None), "4": ("fail", None),
                   "6": ("error", "AnalysisException")}
    flagged = scoring.golden_validation(headers.filter("side = 'expected'").withColumn("database", F.lit("geo")))
    assert {r.name for r in flagged.filter("flagged").collect()} == {"5", "6"}
    timing = scoring.timing_stats(headers.filter("side = 'expected'")).first()
    assert timing.total == 6 and timing.min_time <= timing.avg_time <= timing.max_time
