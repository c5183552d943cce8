"""Removal of long byte strings that occur more than once, by sorting suffixes.

Sorting the suffixes at every byte would move each byte hundreds of times. The
suffixes that matter start at anchors: the smallest k-gram of every window of
the required length, by hash. Equal windows have their smallest k-gram at the same
place, so two windows are equal only if an anchor matches and the bytes on
both sides of it do. Anchors whose whole surroundings recur are settled by
counting. The others lie where a repeat begins or ends; their suffixes go
through the merge sort, which tells how far each agrees with any other, and only
the windows within that reach are counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .grams import Ranges, byte_slices, mix
from .merge_sort import sorted_neighbours
from .names import free_prefix

LENGTH = 200
GRAM = 48
_KEY = ["id", "digest"]


def _sliding_minimum(values, width):
    """Minimum of each ``width`` consecutive values, from minima inside blocks of that width."""
    fill = np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _windows_by_anchor(data, offsets, length, gram):
    """Runs of windows with one anchor: text number, first window, count, anchor (places in ``data``), hashes of anchor and surroundings."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = Ranges(data)
    starts = np.arange(len(data) - gram + 1)
    grams = sums.hash(starts, starts + gram)
    bits = np.uint64(len(data).bit_length())
    with np.errstate(over="ignore"):
        least = _sliding_minimum(grams >> bits << bits | starts.astype(np.uint64), length - gram + 1)  # of equal hashes the first
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    window = np.arange(len(anchor))
    text = np.searchsorted(offsets, window, side="right") - 1
    inside = window + length <= offsets[text + 1]
    window, anchor, text = window[inside], anchor[inside], text[inside]
    if not len(window):
        return window, window, window, window, grams[:0], grams[:0]
    fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(window)))
    begin, anchor = window[first], anchor[first]
    around = mix(sums.hash(begin, begin + count - 1 + length) ^ (anchor - begin).astype(np.uint64))
    return text[first], begin, count, anchor, grams[anchor], around


def _keyed(docs: DataFrame, text, key) -> DataFrame:
    """id, digest, text: a row's own key, which only equal rows share; a null id has the smallest number, a null text is empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(t).alias("digest"), t.alias("text"))


def anchors(rows: DataFrame, length, gram) -> DataFrame:
    """id, digest, begin, count, lead, gram, around for every run of windows with one anchor."""
    def run(batches):
        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(2)):
                text, begin, count, anchor, grams, around = _windows_by_anchor(data, offsets, length, gram)
                at = pa.array(text + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(begin - offsets[text], pa.int64()), pa.array(count.astype(np.int32)),
                    pa.array((anchor - begin).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(around.view(np.int64))],
                    ["id", "digest", "begin", "count", "lead", "gram", "around"])

    return rows.mapInArrow(run, "id long, digest long, begin long, count int, lead int, gram long, around long")


def _cut_out(rows: DataFrame, wanted: DataFrame, length) -> DataFrame:
    """around, lead, count, members and the bytes of the windows of each wanted run."""
    def run(batches):
        for batch in batches:
            for text, runs in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py().encode()
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["around"] for r in runs], pa.int64()), pa.array([r["lead"] for r in runs], pa.int32()), pa.array([r["count"] for r in runs], pa.int32()),
                    pa.array([raw[r["begin"]:r["begin"] + r["count"] - 1 + length] for r in runs], pa.binary())], ["around", "lead", "count", "bytes"])

    runs = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("begin", "count", "lead", "around")).alias("runs"))  # one document's
    once = rows.join(runs, _KEY).select("text", "runs")
    return once.mapInArrow(run, "around long, lead int, count int, bytes binary").dropDuplicates(["around"])


def _window_hashes(classes: DataFrame, length) -> DataFrame:
    """window, around, nth for the windows of each class within its reach."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                part = batch.slice(i, 4000)
                data, offsets = next((d, o) for _, d, o in byte_slices(part.column(3), limit=1 << 40))
                lead, count, reach = (part.column(c).to_numpy() for c in (1, 2, 4))
                # the nth window has lead - nth bytes before the anchor and the rest of its length behind it
                n = np.clip(lead - length + reach + 1, 0, count)
                row = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[row] + nth
                yield pa.RecordBatch.from_arrays([
                    pa.array(Ranges(data).hash(at, at + length).view(np.int64)), part.column(0).take(pa.array(row)), pa.array(nth.astype(np.int32))],
                    ["window", "around", "nth"])

    return classes.select("around", "lead", "count", "bytes", "reach").mapInArrow(run, "window long, around long, nth int")


def repeated_spans(rows: DataFrame, length=LENGTH, gram=GRAM) -> DataFrame:
    """id, digest, start, end of byte ranges of ``rows`` (id, digest, text) that repeats cover; ranges may overlap."""
    found = anchors(rows, length, gram)
    grams = written(found.groupBy("gram").agg(F.count("id").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi"))
                    .filter("n > 1").select(F.col("gram").alias("g"), (F.col("lo") != F.col("hi")).alias("mixed")))
    again = written(found.join(grams, F.col("gram") == F.col("g")).select(*_KEY, "begin", "count", "lead", "around", "mixed"))
    span = [*_KEY, F.col("begin").alias("start"), (F.col("begin") + F.col("count") - 1 + length).alias("end")]
    whole = again.filter("NOT mixed").select(*span)

    classes = written(again.filter("mixed").groupBy("around").agg(
        F.count("id").alias("members"), F.min(F.struct(*_KEY, "begin", "count", "lead")).alias("one")).select("around", "members", "one.*"))
    many = classes.filter("members > 1").select(F.col("around").alias("a"))
    whole = whole.union(again.filter("mixed").join(many, F.col("around") == F.col("a")).select(*span))

    strings = written(_cut_out(rows, classes, length))
    suffixes = strings.select(F.expr("substring(bytes, lead + 1)").alias("value"), F.col("around").alias("number"))
    reach = written(sorted_neighbours(suffixes)).withColumnRenamed("number", "a")
    windows = written(_window_hashes(strings.join(reach, F.col("around") == F.col("a")), length))
    twice = written(windows.groupBy("window").agg(F.count("nth").alias("n")).filter("n > 1").select(F.col("window").alias("w")))
    edges = windows.join(twice, F.col("window") == F.col("w")).groupBy("around").agg(F.min("nth").alias("from"), F.max("nth").alias("to"))
    single = classes.filter("members = 1").join(written(edges).withColumnRenamed("around", "a"), F.col("around") == F.col("a"))
    return whole.union(single.select(
        *_KEY, (F.col("begin") + F.col("from")).alias("start"), (F.col("begin") + F.col("to") + length).alias("end")))


def merged_spans(spans):
    """Sorted ranges without overlaps; touching ranges are one."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _with_spans(docs: DataFrame, text, key, length, gram) -> DataFrame:
    """``docs`` with the ranges of each row in a column whose name comes second; its own columns stay."""
    rows = _keyed(docs, text, key)
    spans = repeated_spans(rows, length, gram)
    p = free_prefix(docs, "s_")
    # touching ranges are joined from their order; a document's ranges are fewer than its bytes
    listed = written(spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("ranges")).select(
        F.col("id").alias(f"{p}id"), F.col("digest").alias(f"{p}digest"), F.array_sort("ranges").alias(f"{p}ranges")))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = (F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))) == F.col(f"{p}id")) & (F.xxhash64(t) == F.col(f"{p}digest"))
    return docs.join(listed, same, "left").drop(f"{p}id", f"{p}digest"), f"{p}ranges"


def without_repeats(docs: DataFrame, text="text", key="doc_id", length=LENGTH, gram=GRAM) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans of every row.

    Every byte inside a string of ``length`` bytes that also starts anywhere
    else, in the same or another document, is removed, judged on the texts as
    they come. A null text is empty; rows without a key, and repeated rows, are
    documents of their own (so repeated rows of that length lose everything). An empty
    table gives no rows; other columns are not read.
    """
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, spans, at, kept = (text or "").encode(), merged_spans((s["start"], s["end"]) for s in spans or ()), 0, []
                for start, end in spans:
                    kept.append(raw[at:start])
                    at = end
                kept.append(raw[at:])
                out.append((len(raw), sum(e - s for s, e in spans), len(spans), b"".join(kept), [{"start": s, "end": e} for s, e in spans]))
            n, removed, count, kept, spans = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["key", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows, ranges = _with_spans(rows, "text", "key", length, gram)
    rows = rows.select("key", "text", ranges)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def removal_digests(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned_documents(docs: DataFrame, text="text", key="doc_id", length=LENGTH, gram=GRAM) -> DataFrame:
    """``docs`` with the repeats taken out of their texts; all rows and columns stay.

    A character that loses some of its bytes goes as a whole. Null texts stay null. Columns may have any names.
    """
    @F.pandas_udf("string")
    def clean(texts, ranges):
        import pandas as pd

        out = []
        for t, spans in zip(texts, ranges):
            if t is None or spans is None:
                out.append(t)
                continue
            raw, at, kept = t.encode(), 0, []
            for start, end in merged_spans((s["start"], s["end"]) for s in spans):
                kept.append(raw[at:start].decode("utf-8", "ignore"))
                at = end
            out.append("".join([*kept, raw[at:].decode("utf-8", "ignore")]))
        return pd.Series(out, dtype=object)

    found, ranges = _with_spans(docs, text, key, length, gram)
    return found.withColumn(text, clean(F.col(text), F.col(ranges))).select(*[F.col(f"`{c}`") for c in docs.columns])
