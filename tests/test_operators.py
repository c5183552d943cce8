"""Operators against plain Python on small fixtures, with hot groups."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querytally.operators import corpus, dumps, runs, scoring
from querytally.operators.assemble import assembled
from querytally.operators.joins import lookup_with_fallback, not_in, top_ranked
from querytally.operators.nearest import nearest_objects
from querytally.operators.numbering import number_rows, number_within
from querytally.operators.ordered import carry, chunked, running_sum


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows, many rows share one sort value."""
    rnd = random.Random(3)
    data = [("big" if rnd.random() < 0.7 else f"g{rnd.randrange(40)}", 0 if rnd.random() < 0.5 else rnd.randrange(1000), i)
            for i in range(6000)]
    return data, spark.createDataFrame(data, "g string, v long, id long").repartition(6)


def test_number_rows(hot):
    data, df = hot
    got = {r["id"]: r["n"] for r in number_rows(df, ["v", "id"]).collect()}
    want = {row[2]: i + 1 for i, row in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}
    assert got == want


def test_number_within(hot):
    data, df = hot
    got = {r["id"]: r["n"] for r in number_within(df, ["g"], ["v", "id"]).collect()}
    want, seen = {}, {}
    for g, v, i in sorted(data):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want


def test_running_sum_and_carry(hot):
    data, df = hot
    df = df.withColumn("x", F.when(F.col("v") % 7 == 0, F.col("v")))
    total = {r["id"]: r["s"] for r in running_sum(chunked(df, "id", 100), ["g"], "id", F.col("v"), "s").collect()}
    both = carry(chunked(df, "id", 50), ["g"], "id", {"p": F.col("x")}, {"q": F.col("x")}).collect()
    back, ahead = {r["id"]: r["p"] for r in both}, {r["id"]: r["q"] for r in both}
    sums, last, nxt = {}, {}, {}
    for g, v, i in sorted(data, key=lambda r: r[2]):
        sums[g] = sums.get(g, 0) + v
        assert total[i] == sums[g]
        assert back[i] == last.get(g)
        if v % 7 == 0:
            last[g] = v
    for g, v, i in sorted(data, key=lambda r: -r[2]):
        if v % 7 == 0:
            nxt[g] = v
        assert ahead[i] == nxt.get(g)


def line_kind(line):
    return "note" if line.startswith("--") else "blank" if not line.strip() else "text"


def strip_expected(lines):
    """The rules on runs of like lines: a run of notes stays only behind text,
    a run of blanks shrinks to its first line and stays only between texts."""
    lines = [x for x in lines if not x.startswith("SELECT") and not x.startswith("SET")]
    runs = [(kind, list(run)) for kind, run in itertools.groupby(lines, line_kind)]
    behind = [None, *(kind for kind, _ in runs)]
    solid = [(kind != "blank", x) for (kind, run), before in zip(runs, behind) if kind != "note" or before == "text" for x in run]
    blocks = [(full, [x for _, x in block]) for full, block in itertools.groupby(solid, lambda p: p[0])]
    if blocks and not blocks[0][0]:
        blocks = blocks[1:]
    if blocks and not blocks[-1][0]:
        blocks = blocks[:-1]
    return [x for full, block in blocks for x in (block if full else block[:1])]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_strip_lines(spark, chunk):
    rnd = random.Random(11)
    choice = ["", "  ", "\t", "-- note", "--", "SET x;", "SELECT 1;", "INSERT (1);", "text", " -- in"]
    files = {f"f{k}": [rnd.choice(choice) for _ in range(n)] for k, n in enumerate([0, 1, 2, 5, 30, 30, 200, 400])}
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, line_no long, line string").repartition(5)
    got = {}
    for r in dumps.strip_lines(df, chunk_rows=chunk).orderBy("file", "line_no").collect():
        got.setdefault(r["file"], []).append(r["line"])
    for f, lines in files.items():
        assert got.get(f, []) == strip_expected(lines), f


def parts_expected(text, limit):
    """Cut at the last statement end of each window of the file."""
    if len(text) <= limit:
        return [text]
    ends = sorted({i + 3 for mark in (b"';\n", b");\n") for i in range(len(text)) if text.startswith(mark, i)})
    windows = {}
    for e in ends:
        windows[(e - 1) // limit] = e
    cuts = [0, *[windows[w] for w in sorted(windows)]]
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def test_part_numbers(spark):
    rnd = random.Random(5)
    choice = ["INSERT (1, 'é');", "INSERT ('a", "b', 2);", "x';", "plain", "", "longer line without an end " * 3]
    files = {f"f{k}": [rnd.choice(choice) for _ in range(n)] for k, n in enumerate([1, 4, 50, 300])}
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, line_no long, line string").repartition(5)
    got = {}
    for r in dumps.part_numbers(df, limit=200, chunk_rows=7).orderBy("file", "line_no").collect():
        got.setdefault(r["file"], {}).setdefault(r["part"], []).append(r["line"] + "\n")
    for f, lines in files.items():
        want = parts_expected("".join(line + "\n" for line in lines).encode(), 200)
        assert ["".join(got[f][p]).encode() for p in sorted(got[f])] == want, f
        assert sorted(got[f]) == list(range(len(want)))


@pytest.mark.parametrize("values", [4_000_000, 80])
def test_nearest(spark, values):
    """Any block size against brute force; ties go by id."""
    rng = np.random.default_rng(1)
    objects = rng.normal(size=(300, 8))
    objects[17] = objects[3]
    queries = rng.normal(size=(25, 8))
    queries[4] = objects[3]
    o = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(objects)] + [(999, None)], "object_id long, vector array<float>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<float>")
    got = nearest_objects(q, o, 4, 8, block_values=values, objects_per_block=70).collect()
    assert len(got) == 100
    ov, qv = objects.astype("float32").astype(float), queries.astype("float32").astype(float)
    s = (qv / np.linalg.norm(qv, axis=1, keepdims=True)) @ (ov / np.linalg.norm(ov, axis=1, keepdims=True)).T
    for r in got:
        i = int(r["query_id"][1:])
        order = sorted(range(300), key=lambda j: (-round(s[i, j], 9), j))
        assert order[r["rank"] - 1] == r["object_id"]
        assert abs(s[i, r["object_id"]] - r["score"]) < 1e-9


@pytest.mark.parametrize("values", [4_000_000, 8])
def test_nearest_in_scope(spark, values):
    o = spark.createDataFrame([(i, ["x", "y"][i % 2], [1.0, float(i)]) for i in range(20)] + [(50, None, [1.0, 3.0]), (51, None, None)], "object_id int, db string, vector array<float>")
    q = spark.createDataFrame([(n, db, [1.0, 3.0]) for n, db in ((1, "x"), (2, "y"), (3, "none"), (5, None))] + [(4, "x", [0.0, 0.0])],
                              "query_id int, db string, vector array<float>")
    got = {(r.query_id, r["rank"]): r.object_id for r in
           nearest_objects(q, o, 2, 2, scope="db", block_values=values, objects_per_block=5).collect()}
    assert got == {(1, 1): 4, (1, 2): 2, (2, 1): 3, (2, 2): 5, (5, 1): 50}
    with pytest.raises(Exception, match="several lengths"):
        nearest_objects(q, o, 2, 3, scope="db").collect()


def test_sample_evenly(spark):
    rows = [(d, f"{i:05d}") for d, n in (("a", 173), ("b", 50), ("c", 51), ("d", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, name string").repartition(4)
    got = {}
    for r in corpus.sample_evenly(df, "dataset", ["name"]).orderBy("name").collect():
        got.setdefault(r["dataset"], []).append(int(r["name"]))
    for d, n in (("a", 173), ("b", 50), ("c", 51), ("d", 7)):
        want = [round(i * ((n - 1) / 49)) for i in range(50)] if n > 50 else list(range(n))
        assert got[d] == want


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a long")
    some = spark.createDataFrame([(2,), (3,)], "b long")
    with_null = spark.createDataFrame([(2,), (None,)], "b long")
    assert [r.a for r in not_in(left, some, "a", "b").collect()] == [1]
    assert not_in(left, with_null, "a", "b").collect() == []
    assert not_in(left, some.limit(0), "a", "b").count() == 3


def test_top_ranked(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "id long, h long")
    assert sorted(r.id for r in top_ranked(df, "h").collect()) == [2, 3]
    gap = df.unionByName(spark.createDataFrame([(4, None)], "id long, h long"))
    assert [r.id for r in top_ranked(gap, "h").collect()] == [4]


def test_prefix_match(spark):
    df = spark.createDataFrame([("north", "geo"), ("east", "x"), ("noon", "world")], "dataset string, database string")
    assert corpus.prefix_match(df, ["n", "north_g"]).count() == 2
    assert corpus.prefix_match(df, [" n", "north_g "], faithful=True).count() == 3


def test_lookup_prefers_first_key(spark):
    entries = spark.createDataFrame([("A", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double")
    rows = spark.createDataFrame([("A",), ("B",), ("C",)], "x string")
    got = lookup_with_fallback(rows, entries, F.col("x"), F.lower("x"), "k", ["v"]).collect()
    assert {r.x: r.v for r in got} == {"A": 1.0, "B": 3.0, "C": None}


def test_lists_and_texts_in_pieces(spark):
    df = spark.range(2500).select(F.lit("d").alias("dataset"), F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))
    lists = scoring.name_lists(df.repartition(7), ["dataset"], per_piece=1000).orderBy("piece").collect()
    assert [len(r["names"]) for r in lists] == [1000, 1000, 500]
    assert [n for r in lists for n in r["names"]] == [f"{i:06d}" for i in range(2500)]
    texts = assembled(df, ["dataset"], F.col("name").cast("long"), F.col("name"), ";", per_piece=600).orderBy("piece").collect()
    assert ";".join(r["text"] for r in texts) == ";".join(f"{i:06d}" for i in range(2500))


def test_run_documents_merge_back(spark):
    usage = {u: F.lit(1.5 if u.endswith("cost") else 2) for u in runs.USAGE}
    evals = spark.range(3000).select(
        F.lit("x").alias("dataset"), F.lit("db").alias("database"), F.col("id").cast("string").alias("name"),
        F.lit("q").alias("question"), F.when(F.col("id") % 3 == 0, "pass").when(F.col("id") % 3 == 1, "fail").otherwise("error").alias("status"),
        F.lit(0.25).alias("duration"), F.when(F.col("id") % 3 == 2, "TimeoutError").alias("exception_class"),
        *[v.alias(k) for k, v in usage.items()], F.lit("r").alias("run"))
    files = runs.run_documents(evals, ["run"], per_file=700)
    assert files.count() == 5
    total = runs.merged_totals(files).first()
    assert (total["passing"], total["total"], total["total_duration"], total["request_tokens"]) == (1000, 3000, 750.0, 6000)
    assert runs.merged_names(files, "failed").distinct().count() == 1000
    assert runs.merged_error_counts(files).first()["n"] == 1000
    assert runs.merged_evals(files).count() == 3000
    overall = runs.with_overall(runs.merged_totals(files)).filter("level = 'overall'").first()
    assert overall["ratio"] == 0.33


def test_empty_ratio(spark):
    df = spark.createDataFrame([], "dataset string, status string, duration double")
    row = df.agg(*scoring.totals()).first()
    assert (row["total"], row["ratio"]) == (0, 1.0)


def test_first_rows_sorts_bounded_tasks(spark, monkeypatch):
    """Rows are dealt before they are ranked: usual cases side by side, larger ones by row; both give the first rows."""
    from querytally.operators import compare
    from querytally.operators.scoring import first_rows

    monkeypatch.setattr(compare, "TASK_ROWS", 100)
    monkeypatch.setattr(compare, "CASE_ROWS", 300)
    rows = spark.range(3000).selectExpr(
        "if(id % 2 = 0, 1, if(id % 31 = 0, null, id % 97)) case", "if(id % 3 = 0, 'expected', 'actual') side", "3000 - id row_id",
        "array(cast(id as string)) cells").coalesce(1).cache()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.row_id):
        want.setdefault((r.case, r.side), []).append((r.row_id, len(want.get((r.case, r.side), ())) + 1))
    got = {}
    found = first_rows(rows, ["case"], 4)
    plan = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x or "WindowGroupLimit" in x]
    for r in sorted(found.collect(), key=lambda r: r.row_id):
        got.setdefault((r.case, r.side), []).append((r.row_id, r["rank"]))
    assert got == {k: v[:4] for k, v in want.items()}
    lowest = [x for at, x in enumerate(plan) if "WindowGroupLimit" not in x and at and "WindowGroupLimit" in plan[at - 1]]
    assert len([x for x in lowest if ", 30), REPARTITION_BY_NUM" in x]) == 1  # the usual ones
    assert len([x for x in lowest if "row_id" in x and ", 16), REPARTITION_BY_NUM" in x]) == 1  # the large one
