"""Quality by importance resampling.

Two generative models over hashed byte trigrams: one of target text (documents
labelled good) and one of the raw corpus. A document's log weight is the log
ratio of its probabilities under both, and the k largest of log weight plus
Gumbel noise are a sample of k documents without replacement, drawn in
proportion to their weights. k follows from the labels: the share of good
documents among the labelled ones, of all documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import number_rows
from ..session import written
from .grams import byte_slices, trigrams
from .names import free_name

BITS = 15
TARGET_ROWS = 50_000  # labelled good documents the target model is fitted on, chosen by a hash of their id
SMOOTHING = 1.0
_AS_IS = np.arange(256, dtype=np.uint8)


def _buckets(column):
    for first, data, offsets in byte_slices(column):
        whole = data.tobytes()
        yield first, trigrams([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], _AS_IS, BITS)


def _known(labels: DataFrame) -> DataFrame:
    """doc_id and good of labelled documents; contradicting labels make a document not good."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def log_ratios(docs: DataFrame, labels: DataFrame, text="text", target_rows=TARGET_ROWS) -> np.ndarray:
    """Log of target over raw probability for each bucket.

    The raw model counts all documents. The target model counts about
    ``target_rows`` good ones at most; their ids are what is broadcast.
    """
    good = _known(labels).filter("good").select(F.col("doc_id").alias("__good"))
    share = target_rows / max(1, good.count())
    if share < 1:
        good = good.filter(F.pmod(F.xxhash64("__good"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for first, (buckets, edges) in _buckets(batch.column(0)):
                sums[0] += np.bincount(buckets, minlength=1 << BITS)
                own = np.repeat(target[first:first + len(edges) - 1], np.diff(edges))
                sums[1] += np.bincount(buckets[own], minlength=1 << BITS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left").select(
        "text", F.col("__good").isNotNull().alias("target"))
    found = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    sums = np.full((2, 1 << BITS), SMOOTHING)
    for r in found:  # at most 2**BITS rows
        sums[0, r.bucket] += r.raw
        sums[1, r.bucket] += r.target
    if sums[1].sum() == SMOOTHING * (1 << BITS):
        return np.zeros(1 << BITS)  # no good documents known: nothing tells documents apart
    p = np.log(sums / sums.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def log_weight(docs: DataFrame, ratios: np.ndarray, text="text") -> Column:
    """Log weight of each row's text; a null or empty text has 0."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for first, (buckets, edges) in _buckets(pa.array(texts, pa.string(), from_pandas=True)):
            filled = np.flatnonzero(np.diff(edges))
            if len(filled):
                out[first + filled] = np.add.reduceat(shipped.value[buckets], edges[filled])
        out[(texts.isna() | (texts == "")).to_numpy()] = 0
        return pd.Series(np.round(out, 6))

    return weigh(F.col(text).cast("string"))


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise that depends on the seed and the columns' values only."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _keyed(docs, labels, text, target_rows, seed, weight="weight", key="key"):
    ratios = log_ratios(docs, labels, text, target_rows)
    return docs.withColumn(weight, log_weight(docs, ratios, text)).withColumn(key, F.col(weight) + gumbel(seed, "doc_id"))


def _least_key(keys: DataFrame, labels: DataFrame) -> float:
    """The k-th largest key of (doc_id, key); without labelled documents all are kept."""
    share = keys.select("doc_id").distinct().join(_known(labels), "doc_id").agg(F.avg(F.col("good").cast("double")).alias("s")).first().s
    count = keys.count()
    k = count if share is None else round(share * count)
    if k >= count:
        return float("-inf")
    if k == 0:
        return float("inf")
    return number_rows(keys.select("key"), [F.desc("key")]).filter(F.col("n") == k).first()["key"]


def resampled(docs: DataFrame, labels: DataFrame, text="text", target_rows=TARGET_ROWS, seed=1) -> DataFrame:
    """doc_id, log_weight, key and kept of every row of ``docs``.

    A null or empty text has log weight 0 and is sampled by its noise. Rows
    with equal keys, such as repeated rows, are kept or dropped together. A null doc_id has
    no label. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    keys = written(_keyed(rows, labels, "text", target_rows, seed).select("doc_id", "weight", "key"))
    return keys.select(
        "doc_id", F.col("weight").alias("log_weight"), "key", (F.col("key") >= _least_key(keys, labels)).alias("kept"))


def sampled_documents(docs: DataFrame, labels: DataFrame, text="text", target_rows=TARGET_ROWS, seed=1) -> DataFrame:
    """The rows of ``docs`` that the sample takes, with their columns; cases as in ``resampled``.

    Texts are weighed again in place of a join, so they are never shuffled. Columns may have any names.
    """
    weight, key = free_name(docs, "weight"), free_name(docs, "key")
    keyed = _keyed(docs, labels, text, target_rows, seed, weight, key)
    least = _least_key(written(keyed.select("doc_id", F.col(key).alias("key"))), labels)
    return keyed.filter(F.col(key) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
