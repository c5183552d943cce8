"""Writers that publish in one step, digests level by level, many prefixes, and runs of many queries."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from querytally.operators import corpus, execute
from querytally.operators.assemble import tree_digests
from querytally.sources import cases, runs


def files_under(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def case_rows(spark, n, mark):
    return spark.range(0, n, 1, 4).select(
        F.concat(F.lit("d "), F.col("id") % 3).alias("dataset"), F.concat(F.lit("n%20é+ -"), "id").alias("name"), F.lit("geo").alias("database"),
        F.lit(f'who "{mark}"?\nline').alias("question"), F.when(F.col("id") % 2 == 0, "SELECT 1").alias("query"))


def test_cases_are_written_by_tasks(spark, tmp_path):
    root = f"{tmp_path}/out"
    cases.write_cases(case_rows(spark, 50, "old"), root)
    assert files_under(root) == {f"d {i % 3}/evals/n%20é+ -{i}/eval.json" for i in range(50)}
    with open(f"{root}/d 1/evals/n%20é+ -1/eval.json") as f:
        assert json.load(f) == {"database": "geo", "question": 'who "old"?\nline'}
    cases.write_cases(case_rows(spark, 10, "new"), root)
    got = {r.name: r.question for r in cases.read_cases(spark, root).collect()}
    assert len(got) == 50 and all(("new" in got[f"n%20é+ -{i}"]) == (i < 10) for i in range(50))
    cases.write_cases(case_rows(spark, 0, "none"), root)
    assert len(files_under(root)) == 50


def test_failed_write_leaves_old_cases(spark, tmp_path):
    root = f"{tmp_path}/out"
    cases.write_cases(case_rows(spark, 20, "old"), root)
    bad = case_rows(spark, 20, "new").withColumn("query", F.when(F.col("name") == "n%20é+ -19", F.raise_error(F.lit("broken"))).otherwise("SELECT 2"))
    with pytest.raises(Exception, match="broken"):
        cases.write_cases(bad, root)
    assert files_under(root) == {f"d {i % 3}/evals/n%20é+ -{i}/eval.json" for i in range(20)}
    assert {r.question for r in cases.read_cases(spark, root).collect()} == {'who "old"?\nline'}


def tree(digests, fan):
    while len(digests) > 1:
        parts = [digests[i:i + fan] for i in range(0, len(digests), fan)]
        digests = [p[0] if len(p) == 1 else hashlib.md5("".join(p).encode()).hexdigest() for p in parts]
    return digests[0]


@pytest.mark.parametrize("fan", [2, 5, 256])
def test_tree_digests(spark, fan):
    sizes = {"one": 1, "few": 7, "many": 130, None: 11}
    rows = [(t, i, f"é{t}{i}\n" * (i % 4)) for t, n in sizes.items() for i in range(n)]
    pieces = spark.createDataFrame(rows[::-1], "table_name string, piece long, ddl string")
    want = {t: tree([hashlib.md5(d.encode()).hexdigest() for u, _, d in rows if u == t], fan) for t in sizes}
    assert {r.table_name: r.digest for r in tree_digests(pieces, ["table_name"], fan=fan).collect()} == want
    assert tree_digests(pieces.filter("false"), ["table_name"], fan=fan).count() == 0


def test_many_prefixes(spark):
    entries = spark.range(2000).select(
        F.concat(F.lit("d"), F.col("id") % 40).alias("dataset"), F.concat(F.lit("b"), F.col("id") % 7).alias("database"), "id")
    prefixes = [f"d{i}_b{i % 7}" for i in range(30)] + ["d1", "d1 ", " d3", "", "no"] + [f"x{i}" for i in range(100_000)]
    frame = spark.createDataFrame([(p,) for p in [*prefixes, None]], "prefix string")
    wanted = [p.strip() for p in prefixes[:35]]
    expected = {i: sum(f"d{i % 40}_b{i % 7}".startswith(p) for p in wanted) for i in range(2000)}
    got = corpus.prefix_match(entries, frame, faithful=True)
    assert got.columns == entries.columns
    assert {r.id: r["count"] for r in got.groupBy("id").count().collect()} == {i: n for i, n in expected.items() if n}
    assert corpus.prefix_match(entries, [p for p in prefixes[:34] if p]).count() == sum(n > 1 for n in expected.values())
    assert corpus.prefix_match(entries, []).count() == 0


def test_report_is_published_in_one_step(spark, tmp_path):
    store = f"{tmp_path}/store"
    run = spark.createDataFrame([("ci", None, None, "t", "{}", "{}")], "source string, start_time timestamp, end_time timestamp, task string, scores string, details string")
    evals = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "name string, duration double")
    runs.append_report(run, evals, store, run_id="1e5")
    broken = run.withColumn("task", F.raise_error(F.lit("stopped here")).cast("string"))
    with pytest.raises(Exception, match="stopped here"):
        runs.append_report(broken, evals, store, run_id="77")
    with pytest.raises(Exception, match="stopped here"):
        runs.append_report(broken, evals, store, run_id="never")
    stored, children = runs.read_report(spark, store)
    assert [r.id for r in stored.collect()] == ["1e5"] and {(r.run_id, r.name) for r in children.collect()} == {("1e5", "a"), ("1e5", "b")}
    for _ in range(2):  # repeated, and repeated once too often
        assert runs.append_report(run, evals.limit(1), store, run_id="77") == "77"
    stored, children = runs.read_report(spark, store)
    assert sorted(r.id for r in stored.collect()) == ["1e5", "77"]
    assert sorted((r.run_id, r.name) for r in children.collect()) == [("1e5", "a"), ("1e5", "b"), ("77", "a")]
    assert runs.drop_unpublished(spark, store) == ["never"] and runs.drop_unpublished(spark, store) == []


def test_endless_query_is_stopped(spark, tmp_path):
    queries = [("s", f"{i:02d}", "geo", "SELECT 1 AS a") for i in range(8)]
    queries[2] = ("s", "02", "geo", "SELECT count(*) AS a FROM range(1000000000000) x WHERE xxhash64(x.id) = 1")
    df = spark.createDataFrame(queries, "dataset string, name string, database string, query string")
    execute.run_cases(df, "expected", f"{tmp_path}/out", parallel=2, limit=8)
    headers, rows = execute.read_outcomes(spark, f"{tmp_path}/out")
    failed = {r.name: r for r in headers.filter("error IS NOT NULL").collect()}
    assert set(failed) == {"02"} and 7 < failed["02"].seconds < 60
    assert rows.count() == 7 and headers.count() == 8


def test_table_is_replaced_when_its_files_are_there(spark, tmp_path):
    from querytally.sources import databases

    databases.replace_table(spark.range(5), str(tmp_path), "t")
    with pytest.raises(Exception, match="broken"):
        databases.replace_table(spark.range(9).withColumn("x", F.when(F.col("id") == 8, F.raise_error(F.lit("broken")))), str(tmp_path), "t")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 5 and sorted(os.listdir(tmp_path)) == ["t.parquet"]
    again = spark.read.parquet(f"{tmp_path}/t.parquet")
    databases.replace_table(again.union(again), str(tmp_path), "t")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 10 and sorted(os.listdir(tmp_path)) == ["t.parquet"]
    assert databases.register_database(spark, str(tmp_path)) == ["t"]
