import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from querytally.plans import QUERIES as QUERIES_OF_PLANS
from oracle import actual, actual_types, connect, expected, expected_types

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# the other registered queries have tests of their own beside their operators
QUERIES = {name: q for name, q in entry_module.queries().items() if name in QUERIES_OF_PLANS}
ORACLES = entry_module.oracle_sql()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Executed:
    """Plans of everything the session runs inside the block, jobs that operators start themselves included."""

    def __init__(self, spark):
        self._store = spark._jsparkSession.sharedState().statusStore()
        self._bus = spark.sparkContext._jsc.sc().listenerBus()

    def _ids(self):
        self._bus.waitUntilEmpty(20_000)
        found = self._store.executionsList()
        return {found.apply(i).executionId(): found.apply(i) for i in range(found.size())}

    def __enter__(self):
        self._before = set(self._ids())
        return self

    def __exit__(self, *error):
        self.plans = [e.physicalPlanDescription() for i, e in self._ids().items() if i not in self._before]


def pairs_everything(plan):
    return "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    with Executed(spark) as run:
        df = QUERIES[name](spark, SF)
        columns, rows = actual(df)
    assert run.plans
    assert not [p for p in run.plans if pairs_everything(p)]
    if name in ORACLES:
        want_columns, want = expected(con, ORACLES[name])
        assert columns == want_columns
        assert actual_types(df) == expected_types(con, ORACLES[name])
        assert len(rows) == len(want)
        wrong = [(a, b) for a, b in zip(rows, want) if a != b]
        assert not wrong, wrong[:3]
    else:
        assert rows


def test_inner_jobs_are_seen(spark, monkeypatch):
    """A nested-loop join planted inside the comparison is found, though the returned frame only reads files."""
    from querytally.operators import compare

    plain = compare.column_profile

    def planted(headers, rows, keys):
        return plain(headers, rows, keys).join(spark.range(1).withColumnRenamed("id", "__one"), F.lit(1) <= F.col("__one") + 1).drop("__one")

    monkeypatch.setattr(compare, "column_profile", planted)
    with Executed(spark) as run:
        df = QUERIES["compare_results"](spark, SF)
    assert not pairs_everything(plan_of(df)) and [p for p in run.plans if pairs_everything(p)]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_scans_are_narrow(spark):
    """Filters and column lists reach the Parquet scan."""
    plan = plan_of(QUERIES["ts_half_open"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan and "LessThan(o_orderdate,1997-01-01" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
    plan = plan_of(QUERIES["in_subquery"](spark, SF))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "GreaterThan(o_totalprice,400000.0)" in plan
    plan = plan_of(QUERIES["order_offset"](spark, SF))
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_row_comparison_spreads_a_case(spark):
    """Rows of one case are grouped by content, not kept on the case's partition."""
    from pyspark.sql import functions as F
    from querytally.operators.compare import _exact_matches

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(10).select(
            F.lit(1).alias("case"), F.lit("actual").alias("side"), F.col("id").alias("row_id"),
            F.array(F.col("id").cast("string")).alias("cells"))
        attempts = spark.range(3).select(F.col("id").cast("int").alias("case"), F.col("id").alias("attempt"), F.array(F.lit(0)).alias("mapping"))
        plan = plan_of(_exact_matches(rows, attempts, ["case"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    grouping = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "line#" in x]
    assert grouping and any("__salt" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("name", ["question_files", "table_metadata"])
def test_documents_hold_blocks_only(spark, con, monkeypatch, tmp_path, name):
    """No JSON document has more rows than a block, and what is read back is whole."""
    import glob
    import json

    from querytally.plans import storage

    monkeypatch.setattr(storage, "BLOCK", 2)
    monkeypatch.setattr(storage, "work_path", lambda _: f"{tmp_path}/{name}")
    assert actual(QUERIES[name](spark, "/root/testdata/sf0.01")) == expected(connect("/root/testdata/sf0.01"), ORACLES[name])
    documents = [json.loads(line) for f in glob.glob(f"{tmp_path}/{name}/**/*.txt", recursive=True) for line in open(f)]
    sizes = [len(d) if isinstance(d, list) else max(map(len, d["table_metadata"].values())) for d in documents]
    assert len(sizes) > 5 and max(sizes) == 2


def test_digests_of_whole_texts_join_no_pieces(spark):
    """Two tables of many pieces: right digests, and the plan gathers the lines of a piece but no pieces."""
    import hashlib

    from querytally.plans.catalog import joined_digests

    rows = [(f"t{i % 2}", i // 2, f"é{i}\n" * (i % 5)) for i in range(3000)]
    want = {t: hashlib.md5("".join(d for u, _, d in rows if u == t).encode()).hexdigest() for t in ("t0", "t1")}
    pieces = spark.createDataFrame(rows[::-1], "table_name string, piece long, ddl string")
    assert {r.table_name: r.digest for r in joined_digests(pieces).collect()} == want
    assert joined_digests(pieces.filter("false")).count() == 0
    assert "collect_list(struct(piece" not in plan_of(QUERIES["whole_table_text"](spark, SF))


def test_digest_is_of_the_whole_text(spark, tmp_path):
    """The digest of a definition of several pieces is that of its text joined in order."""
    import hashlib

    lines = spark.range(9001).select(
        (F.col("id") % 1013).alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"),
        F.when(F.col("id") < 5000, F.lit(1)).otherwise(F.col("id") % 7 * 2).cast("long").alias("l_suppkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.table_name: r.digest for r in QUERIES["whole_table_text"](spark, str(tmp_path)).collect()}
    text = lambda name, n: f"CREATE TABLE {name}\n(\n" + ",\n".join(f"    c{i} text NULL" for i in range(1, n + 1)) + "\n);\n"
    assert got == {name: hashlib.md5(text(name, n).encode()).hexdigest() for name, n in (("p0", 4001), ("p1", 5000))}
