from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from oracle import connect
from querytally.llm.importance import resampled
from querytally.llm.quality_rules import ORACLE
from querytally.session import written
from test_near_duplicates import brute as groups
from test_packing import check
from test_repeats import brute_parts

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage(spark):
    """Each stage against its definition, on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outputs, before = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before = written(stage(spark, before, SF))
        outputs.append(before)
        if len(outputs) < len(corpus_pipeline.STAGES):
            assert before.columns == docs.columns, name
    ruled, sampled, unique, cleaned = (rows_of(df) for df in outputs[:4])
    accepted = {r[0] for r in connect(SF).execute(f"SELECT doc_id FROM ({ORACLE}) WHERE kept").fetchall()}
    assert set(ruled) == accepted and 0 < len(ruled) < docs.count()
    taken = resampled(outputs[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    assert set(sampled) == {r.doc_id for r in taken.collect()}
    assert set(unique) == {i for i, _, _, kept in groups([(i, r.text) for i, r in sampled.items()], 5, 80) if kept}
    want = {i: "".join(p.decode("utf-8", "ignore") for p in parts) for i, _, _, parts in brute_parts([(i, r.text) for i, r in unique.items()], 200)}
    assert {i: r.text for i, r in cleaned.items()} == want and all(r.n_chars == len(r.text) for r in cleaned.values())
    assert check(outputs[4].collect(), {i: r.text for i, r in cleaned.items()}) < 0.02


def test_stages_keep_any_columns(spark):
    """Columns that are named like a stage's own work neither change nor change the rows."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [
        "__key", "key", "Weight", "__weight", "q", "q_text", "q1_cuts", "Q_stratum", "cut_lines", "__stratum", "__ranges", "__id", "s_ranges",
        "S_id", "gone", "id", "digest", "number", "row", "component", "node", "n_words", "kept", "u", "v"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        plain = {tuple(r) for r in stage(spark, docs, small).collect()}
        odd = stage(spark, docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names}), small)
        assert odd.columns == [*docs.columns, *names]
        rows = odd.collect()
        assert {tuple(r)[:len(docs.columns)] for r in rows} == plain
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_run(spark):
    small = "/root/testdata/sf0.001"
    got = entry.queries()["pipeline"](spark, small)
    ids = {r.doc_id for r in got.collect()}
    assert ids and ids <= set(range(200)) and "pipeline" not in entry.oracle_sql()
