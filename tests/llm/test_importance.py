import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from querytally.llm.importance import BITS, gumbel, log_ratios, resampled, sampled_documents
from querytally.llm.queries import op7

SF = "/root/testdata/sf0.1"


def bucket(a, b, c):
    return ((a | b << 8 | c << 16) * 0x9E3779B1 % 2**32) >> (32 - BITS)


def grams(text):
    raw = b" " + (text or "").encode() + b" "
    return [bucket(*raw[i:i + 3]) for i in range(len(raw) - 2)]


def test_weights_against_counts(spark):
    """Log weights and the choice of the largest keys, by plain counting."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    quality = dict(labels.select("doc_id", "quality").collect())
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if quality.get(i) == 1:
            target.update(grams(t))
    size = 1 << BITS
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size)) for b in range(size)]
    got = resampled(docs, labels).collect()
    for r in got:
        assert abs(r.log_weight - sum(ratio[b] for b in grams(texts[r.doc_id]))) < 1e-4
    known = [q for i, q in quality.items() if i in texts]
    k = round(len(got) * sum(known) / len(known))
    assert sorted(r.key for r in got if r.kept) == sorted(r.key for r in got)[-k:]


def test_junk_goes_and_clean_text_stays(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op7(spark, SF).join(labels, "doc_id")
    kept = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.15
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sampled_documents(docs, labels)
    assert rows.columns == docs.columns and rows.count() == op7(spark, SF).filter("kept").count()


def test_gumbel_noise(spark):
    x = np.array([r.g for r in spark.range(20_000).select(gumbel(3, "id").alias("g")).collect()])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.std() - math.pi / 6**0.5) < 0.03


def test_sample_follows_the_weights(spark):
    """Gumbel top-1 picks item i with probability w_i / sum(w)."""
    w = [1.0, 2.0, 5.0]
    rows = spark.range(6000).selectExpr("id AS draw", "explode(array(0, 1, 2)) AS item")
    key = F.log(F.element_at(F.array(*map(F.lit, w)), F.col("item") + 1)) + gumbel(9, "draw", "item")
    picked = Counter(r.i for r in rows.groupBy("draw").agg(F.max_by("item", key).alias("i")).collect())
    for i in range(3):
        assert abs(picked[i] / 6000 - w[i] / sum(w)) < 0.02


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "good text"), (3, "good text"), (None, "no id"), (4, "word " * 50_000), (5, "###")]
    docs = spark.createDataFrame([(*r, 0.0, True) for r in rows], "doc_id long, text string, key double, kept boolean")
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, 1), (None, 1), (4, None), (1, 1)], "doc_id long, quality int")
    got = resampled(docs, labels).collect()
    assert len(got) == len(rows) and {r.log_weight for r in got if r.doc_id in (1, 2)} == {0.0}
    assert len({(r.key, r.kept) for r in got if r.doc_id == 3}) == 1
    assert all(r.kept for r in resampled(docs, labels.filter("false")).collect())
    assert resampled(docs.filter("false"), labels).count() == 0 and not log_ratios(docs, labels.filter("false")).any()
    assert sampled_documents(docs, labels).columns == docs.columns
