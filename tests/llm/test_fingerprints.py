import hashlib
import random

import pytest
from pyspark.sql import functions as F

from querytally.llm.fingerprints import BINS, edited_fingerprints, fingerprints, likeness, with_bins, with_next
from querytally.llm.queries import op6

SF = "/root/testdata/sf0.001"


def edited_texts(rows):
    """The edit by its definition: rows in descending id, the last halves from the next."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = []
    for at, (i, text) in enumerate(rows):
        half = len(text) // 2
        out.append((i, len(text), hashlib.sha256((text[:len(text) - half] + rows[(at + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    return sorted(out)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op6(spark, SF).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited_texts(map(tuple, docs.select("doc_id", "text").collect()))
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by = {r.fingerprint for r in got}
    texts = {r.text: r.doc_id for r in docs.collect()}
    assert len(by) <= len(texts)
    plan = op6(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def shingles(text):
    words = text.split(" ")
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("length", [12, 60, 800])
def test_likeness_is_unbiased(spark, length):
    """Mean error over many pairs is small at any length and the scatter that of BINS bins."""
    rng = random.Random(length)
    rows, true = [], {}
    for i in range(300):
        a = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        cut = rng.randrange(length // 4, length)
        b = a[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(length - cut)]
        a, b = " ".join(a), " ".join(b)
        true[i] = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        rows.append((i, a, b))
    frame = with_bins(with_bins(spark.createDataFrame(rows, "i int, a string, b string"), "a", "x"), "b", "y")
    errors = [r.l - true[r.i] for r in frame.select("i", likeness("x", "y").alias("l")).collect()]
    # in short texts the borrowed bins repeat, so that fewer of them are independent
    spread = (sum(e * e for e in errors) / len(errors)) ** 0.5
    assert abs(sum(errors) / len(errors)) < 0.02 and spread < (0.05 if length > 2 * BINS else 0.12)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "é🙂" * 3), (7, "w " * 30_000), (7, "x"), (8, "one two")]
    frame = spark.createDataFrame([(*r, "f", 1) for r in [*rows, (None, "no id")]], "doc_id long, text string, fingerprint string, n_chars int")
    got = edited_fingerprints(frame).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id) == edited_texts(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "" and by[4].fingerprint == by[8].fingerprint == by[5].fingerprint
    assert by[2].near_next == 1.0 and by[4].near_next == 0.0 and by[5].near_next == 1.0
    assert by[None].near_next is None and by[None].fingerprint and len(got) == len(rows) + 1
    assert edited_fingerprints(frame.filter("false")).count() == 0 and fingerprints(frame).count() == 10
    one = edited_fingerprints(frame.filter("doc_id = 4")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == edited_texts([(4, "one two")])[0][2]


@pytest.mark.parametrize("slices", [1, 2, 7, 50])
def test_next_row_over_any_slices(spark, slices):
    ids = [(i * i % 101 + 1000 * (i % 3), f"t{i}") for i in range(40)]
    got = with_next(spark.createDataFrame(ids, "id long, text string"), "id", ["text"], "text", slices)
    want = sorted(ids, reverse=True)
    assert sorted(map(tuple, got.collect()), reverse=True) == [(*r, want[(i + 1) % len(want)][1]) for i, r in enumerate(want)]
    assert got.select(F.count("id")).first()[0] == 40
