import random

import pytest
from pyspark.sql import functions as F

from querytally.operators import compare
from querytally.operators.compare import compare_results, frames_equal, table_sets_match
from querytally.operators.results import ACTUAL, EXPECTED, result_header, result_rows, unique_names


def frame(spark, **columns):
    names = list(columns)
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    types = [next((kinds[type(v)] for v in vs if v is not None), "long") for vs in columns.values()]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    return spark.createDataFrame(list(zip(*columns.values())), schema).coalesce(1)


PLACES = dict(town=["Oslo", "Lima", None, "Oslo", "Pune"], people=[7, 11, 3, 7, None], dry=[False, True, True, False, None])
CASES = [
    (PLACES, PLACES, True),
    # the columns in another order, under other names, the rows in another order
    (PLACES, {n: PLACES[n] for n in ("dry", "town", "people")}, True),
    (PLACES, {n.upper(): v for n, v in PLACES.items()}, True),
    (PLACES, {n: v[::-1] for n, v in PLACES.items()}, True),
    # a column more on either side
    (PLACES, {n: PLACES[n] for n in ("dry", "people")}, True),
    ({n: PLACES[n] for n in ("dry", "people")}, PLACES, False),
    # one value changed, and one row's repeat lost
    (PLACES, {**PLACES, "people": [7, 11, 3, 8, None]}, False),
    (PLACES, {n: v[1:] for n, v in PLACES.items()}, False),
]
MORE = [
    # same columns, rows put together differently
    (dict(a=[1, 2, 3], b=[4, 5, 6]), dict(a=[1, 2, 3], b=[5, 4, 6]), False),
    # integer against double
    (dict(a=[1, 2]), dict(a=[1.0, 2.0]), False),
    # floats inside and outside the tolerance
    (dict(k=["x", "y"], a=[100.0, 2.0]), dict(k=["x", "y"], a=[100.00001, 2.0]), True),
    (dict(k=["x", "y"], a=[100.0, 2.0]), dict(k=["x", "y"], a=[100.1, 2.0]), False),
    # equal columns whose rows pair up within the tolerance only
    (dict(k=["x", "y"], a=[1.0, 1.000000001]), dict(k=["x", "y"], a=[1.000000001, 1.0]), True),
    (dict(k=["x", "y"], a=[1.0, 1.1]), dict(k=["x", "y"], a=[1.1, 1.0]), False),
    # nulls on both sides; counts of duplicates
    (dict(a=[None, 1, 2], b=["p", None, "q"]), dict(a=[2, None, 1], b=["q", "p", None]), True),
    (dict(a=[1, 1, 2]), dict(a=[1, 2, 2]), False),
    (dict(a=[1, 1, 2]), dict(a=[1, 2]), False),
]


@pytest.mark.parametrize("faithful", [False, True])
def test_compare_table(spark, faithful):
    """All cases in one pass, the way the operator is meant to be used."""
    headers = rows = None
    for i, (actual, expected, _) in enumerate(CASES + MORE):
        for side, data in ((ACTUAL, actual), (EXPECTED, expected)):
            df = frame(spark, **data)
            h, r = result_header(df, {"case": i}, side), result_rows(df, {"case": i}, side)
            headers = h if headers is None else headers.unionByName(h)
            rows = r if rows is None else rows.unionByName(r)
    want = {i: c[2] for i, c in enumerate(CASES + MORE)}
    rows, headers = rows.coalesce(2).cache(), headers.coalesce(2).cache()
    got = {r["case"]: r["passed"] for r in compare_results(headers, rows, ["case"], faithful).collect()}
    assert got == want
    got = {r["case"]: r["passed"] for r in
           compare_results(headers, rows, ["case"], faithful, exact=False).collect()}
    assert got == want


@pytest.mark.parametrize("actual, expected, default, faithful", [
    (dict(a=[1, 2], b=[1, 2]), dict(a=[1, 2], b=[1, 2]), True, False),
    # equal columns, crossed rows: needs the second assignment
    (dict(a=[1, 2, 3], b=[2, 3, 1], c=["x", "y", "z"]), dict(a=[2, 3, 1], b=[1, 2, 3], c=["x", "y", "z"]), True, False),
    (dict(a=[1, 2, 1], b=[2, 1, 1]), dict(a=[1, 2, 1], b=[1, 2, 1]), False, False),
    # the first equal actual column is the wrong one
    (dict(a=[1, 2, 3], b=[2, 1, 3], c=[7, 8, 9]), dict(x=[2, 1, 3], y=[7, 8, 9]), True, False),
])
def test_equal_columns(spark, actual, expected, default, faithful):
    a, e = frame(spark, **actual), frame(spark, **expected)
    assert frames_equal(a, e) is default
    assert frames_equal(a, e, faithful=True) is faithful


def test_empty_results(spark):
    two = spark.createDataFrame([], "a int, b string")
    one = spark.createDataFrame([], "c double")
    assert frames_equal(two, two) is True
    assert frames_equal(two, two, faithful=True) is False
    assert frames_equal(one, one, faithful=True) is True
    assert frames_equal(two, frame(spark, a=[1])) is False


def test_more_types(spark):
    q = """select cast(v as decimal(10,2)) d, date'2024-01-01' + v t, timestamp'2024-01-01 00:00:00' z,
                  v % 2 = 0 b, array(v) x, cast(v as double) / 7 f from (select explode(sequence(1, 20)) v)"""
    a = spark.sql(q)
    assert frames_equal(a.select("f", "x", "b", "z", "t", "d").orderBy("f"), a)
    assert not frames_equal(a.withColumn("b", ~F.col("b")), a)


def test_large_case_with_noise(spark):
    """Float noise in every row, the whole case in many slices."""
    base = spark.range(20000).select("id", (F.sqrt("id") + 0.1).alias("v"))
    noisy = base.select((F.col("v") * (1 + 1e-9)).alias("w"), "id")
    assert frames_equal(noisy, base)
    assert frames_equal(noisy, base, faithful=True)
    assert not frames_equal(noisy.withColumn("w", F.when(F.col("id") == 777, 1.0).otherwise(F.col("w"))), base)


def square(step, n, order=None):
    """Latin square: every column holds the same values, so only the rows tell columns apart."""
    columns = {f"c{j}": [(step[i] + j) % n for i in range(n)] for j in range(n)}
    names = order or list(columns)
    return {f"x{k}": columns[name] for k, name in enumerate(names)}


def test_many_like_columns(spark):
    """Twelve columns that agree by themselves: a shuffled square is equal."""
    names = [f"c{j * 5 % 12}" for j in range(12)]
    assert frames_equal(frame(spark, **square(range(12), 12, names)), frame(spark, **square(range(12), 12)))


def test_no_order_fits(spark):
    """Nine columns that agree by themselves in a square of another structure."""
    n, plain = 9, square(range(9), 9)
    swapped = {k: list(v) for k, v in plain.items()}
    # turn a 2 x 2 part so that rows and columns keep their values but not their alignment
    for k, v in swapped.items():
        v[0], v[1] = v[1], v[0]
    swapped["x0"][0], swapped["x0"][1] = swapped["x0"][1], swapped["x0"][0]
    assert not frames_equal(frame(spark, **swapped), frame(spark, **plain))


def test_all_orders_fit(spark):
    """Every assignment of nine columns is right: one is enough, none is tried twice."""
    unit = {f"c{j}": [int(i == j) for i in range(9)] for j in range(9)}
    assert frames_equal(frame(spark, **unit), frame(spark, **{k: v[::-1] for k, v in unit.items()}))


def test_two_noisy_floats(spark):
    """Noise in the first float must not decide how rows pair in the second."""
    a = frame(spark, x=[1.0, 1.0000000001], y=[5.0, 3.0])
    e = frame(spark, x=[1.0000000001, 1.0], y=[5.0, 3.0])
    assert frames_equal(a, e)
    assert not frames_equal(a, frame(spark, x=[1.0000000001, 1.0], y=[5.0, 3.1]))
    assert not frames_equal(frame(spark, x=[1.0, 2.0], y=[5.0, 3.0]), frame(spark, x=[1.0000000001, 2.0000000001], y=[3.0, 5.0]))


def test_unique_names():
    assert unique_names(["a", "b", "a"]) == ["a_0", "b", "a_2"]
    assert unique_names(["a", "b"]) == ["a", "b"]


def test_table_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "b"]), (["b", "a", "a"], ["a", "b"])],
                               "a array<string>, e array<string>")
    got = df.select(table_sets_match("a", "e", False).alias("l"), table_sets_match("a", "e", True).alias("s")).collect()
    assert [(r.l, r.s) for r in got] == [(True, False), (False, False), (True, True)]


def dense(n, seed=3):
    """Two columns of cents without a gap beyond the tolerance, the first with many ties."""
    rnd = random.Random(seed)
    x = [90_000 + rnd.randrange(n // 2) / 100 for _ in range(n)]
    return x, [90_000 + rnd.randrange(4 * n) / 100 for _ in range(n)]


def test_noise_in_dense_floats(spark):
    """Each column is one step from end to end: rows still pair by both columns."""
    x, y = dense(20_000)
    rnd = random.Random(4)
    shaken = [[v + rnd.choice((-1e-10, 0.0, 1e-10)) for v in c] for c in (x, y)]
    expected = frame(spark, x=x, y=y)
    assert frames_equal(frame(spark, x=shaken[0], y=shaken[1]), expected)
    # both columns agree by themselves, but not together: a few far values of y change rows
    y2 = list(y)
    low, high = sorted(range(len(y)), key=lambda i: y[i])[:: len(y) - 1]
    y2[low], y2[high] = y[high], y[low]
    assert not frames_equal(frame(spark, x=shaken[0], y=[v + 1e-10 for v in y2]), expected)


def test_a_pairing_that_no_sorting_finds(spark):
    """Two rows cross in x within the tolerance and lie apart in y, where other rows close the gap between them."""
    t = 0.9e-5  # a little less than the tolerance at 1
    a = frame(spark, x=[1.0, 1 + t, 3.0, 5.0], y=[1.0, 1 + 3 * t, 1 + t, 1 + 2 * t])
    assert frames_equal(a, frame(spark, x=[1 + t, 1.0, 3.0, 5.0], y=[1.0, 1 + 3 * t, 1 + t, 1 + 2 * t]))
    assert not frames_equal(a, frame(spark, x=[1.0, 3.0, 1 + t, 5.0], y=[1.0, 1 + 3 * t, 1 + t, 1 + 2 * t]))


@pytest.mark.parametrize("faithful", [False, True])
def test_large_cases_are_spread(spark, faithful, monkeypatch):
    """Cases above and below the limit of a task's rows in one run, and cases without a key."""
    monkeypatch.setattr(compare, "CASE_ROWS", 8)
    headers = rows = None
    for i, (actual, expected, _) in enumerate(CASES + MORE):
        for side, data in ((ACTUAL, actual), (EXPECTED, expected)):
            df = frame(spark, **data)
            case = {"case": F.lit(i if i else None).cast("int")}
            h, r = result_header(df, case, side), result_rows(df, case, side)
            headers = h if headers is None else headers.unionByName(h)
            rows = r if rows is None else rows.unionByName(r)
    want = {i if i else None: c[2] and i > 0 for i, c in enumerate(CASES + MORE)}
    rows, headers = rows.coalesce(2).cache(), headers.coalesce(2).cache()
    for exact in (True, False):
        assert {r["case"]: r["passed"] for r in compare_results(headers, rows, ["case"], faithful, exact).collect()} == want


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Rows go to as many tasks as their number asks for, before any grouping, and are then grouped without a further shuffle."""
    monkeypatch.setattr(compare, "TASK_ROWS", 100)
    sides = F.explode(F.array(F.lit(ACTUAL), F.lit(EXPECTED))).alias("side")
    rows = spark.range(2000).select((F.col("id") % 300).alias("case"), sides, F.col("id").alias("row_id"), F.lit("i").alias("kinds"), F.array(F.col("id").cast("string")).alias("cells"))
    parts = compare._parts(rows, rows.count())
    assert parts == 40
    attempts = spark.range(300).select(F.col("id").alias("case"), F.lit(0).alias("attempt"), F.array(F.lit(0)).alias("mapping"), F.lit("i").alias("kinds"))
    for found in (compare._exact_matches(rows.drop("kinds"), attempts, ["case"], parts), compare._hashed_matches(rows.drop("kinds"), attempts, ["case"], parts=parts),
                  compare._tolerant_matches(rows, attempts, ["case"], True, parts)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "line" not in x]
        assert any("hashpartitioning(case" in x and ", 40), REPARTITION_BY_NUM" in x for x in dealt)
        assert not any("Exchange" in x and ("line#" in x or "__salt" in x or "rangepartitioning" in x) for x in plan.split("\n"))
        assert found.count() == 300


def test_order_lines_are_dealt_before_they_are_grouped(spark, monkeypatch, tmp_path):
    """A read task sends its lines as they are, to as many tasks as their number asks for; no grouping grows with it."""
    from querytally.plans import evaluation
    from querytally.plans.registry import Tables

    monkeypatch.setattr(evaluation, "LINES", 100, raising=False)
    spark.range(3000).selectExpr("if(id < 600, 7, if(id < 700, null, id % 900)) l_orderkey", "id % 11 l_partkey", "id / 4 l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).selectExpr("if(id < 990, id, null) o_orderkey", "if(id % 50 = 0, null, id % 40) o_custkey", "'1' o_orderpriority", "id / 2 o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    held = {}
    for r in spark.read.parquet(f"{tmp_path}/lineitem.parquet").filter("l_orderkey IS NOT NULL").collect():
        held.setdefault(r.l_orderkey, []).append(r)
    for repeat in (False, True):
        plans, kept = [], evaluation.written
        monkeypatch.setattr(evaluation, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
        _, rows = evaluation.order_results(Tables(spark, str(tmp_path)), True, repeat)
        monkeypatch.setattr(evaluation, "written", kept)
        below = plans[0][:plans[0].index("lineitem.parquet")].split("\n")
        nearest = [x for x in below if "Exchange" in x or "Aggregate" in x][-1]
        assert "Exchange hashpartitioning(l_orderkey" in nearest and ", 30), REPARTITION_BY_NUM" in nearest
        got = {r.row_id: r.cells for r in rows.filter("side = 'expected'").collect()}
        assert set(got) == set(held) and rows.filter("side = 'actual'").count() == 1000
        for key, cells in got.items():
            assert cells[:3] == [str(key), str(len(held[key])), "1"]
            assert float(cells[3]) == pytest.approx(sum(r.l_extendedprice for r in held[key]))
            assert cells[4:] == ([str(len({r.l_partkey for r in held[key]}))] if repeat else [])


@pytest.mark.parametrize("faithful", [False, True])
def test_one_float_column_takes_one_pass(spark, monkeypatch, faithful):
    """Where one column is a float the ordered pass also decides the attempts of equal columns; no pass by content comes first."""
    def none(*args, **more):
        raise AssertionError("a second pass over the rows")

    monkeypatch.setattr(compare, "_exact_matches", none)
    monkeypatch.setattr(compare, "_hashed_matches", none)
    nan = float("nan")
    x = {"k": ["a", "a", "b", None], "v": [2.0, 0.5, nan, None]}
    same = {"k": ["b", None, "a", "a"], "v": [nan, None, 0.5, 2.0]}
    crossed = {"k": ["a", "b", "a", None], "v": [2.0, 0.5, nan, None]}
    near = {"k": ["b", None, "a", "a"], "v": [nan, None, 0.5000001, 2.0000001]}
    for other, want in ((same, True), (crossed, False), (near, not faithful or None)):
        a, e = (spark.createDataFrame(list(zip(*d.values())), "k string, v double") for d in (other, x))
        got = frames_equal(a, e, faithful)
        assert want is None or got == want
