"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once. The top bits of a hash name its
bin, and the smallest hash of a bin stands for it. An empty bin borrows from the
filled bin that comes first in an order of its own (a hash of both bin numbers):
a uniform and independent choice for every empty bin, the same in any two texts
that fill the same bins, which is what optimal densification asks for. Of every
bin the low-order bits are kept; equal bits that arise by chance are taken out
of the likeness again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
KEPT_BITS = 8
SPACE = r"[\x20\x09-\x0D]+"


def with_bins(df: DataFrame, text: str, to: str, shingle=SHINGLE) -> DataFrame:
    """``df`` with the kept bits of each bin as array ``to``; empty for a text without words.

    Fewer words than a shingle count as one shingle. A null text is empty.
    """
    w, h, s, o, b = (f"{to}_{x}" for x in ("words", "hashes", "sorted", "filled", "numbers"))
    shift, low = 64 - BIN_BITS, (1 << KEPT_BITS) - 1
    run = ", ".join(f"get({w}, i + {j})" for j in range(shingle))
    return (
        df.withColumn(w, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), ""))
        .withColumn(h, F.expr(f"""
            CASE WHEN size({w}) = 0 THEN array() WHEN size({w}) < {shingle} THEN array(xxhash64(array_join({w}, ' ')))
                 ELSE transform(sequence(0, size({w}) - {shingle}), i -> xxhash64({run})) END"""))
        .withColumn(s, F.sort_array(h))
        .withColumn(o, F.expr(f"filter({s}, (x, i) -> i = 0 OR shiftrightunsigned(x, {shift}) <> shiftrightunsigned(get({s}, i - 1), {shift}))"))
        .withColumn(b, F.expr(f"transform({o}, x -> shiftrightunsigned(x, {shift}))"))
        .withColumn(to, F.expr(f"""
            CASE WHEN size({b}) = 0 THEN CAST(array() AS array<smallint>) ELSE
              transform(sequence(0L, {BINS - 1}L), n -> CAST(coalesce(get({o}, CAST(array_position({b}, n) - 1 AS INT)),
                array_min(transform({o}, x -> (xxhash64(n, shiftrightunsigned(x, {shift})) & {~low}L) | (x & {low}L)))) & {low}L AS SMALLINT)) END"""))
        .drop(w, h, s, o, b))


def packed(bins) -> Column:
    """The kept bits as hexadecimal text."""
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), KEPT_BITS // 4, "0")), "")


def likeness(a, b) -> Column:
    """Estimated share of common shingles, from 0 to 1; texts without words are like each other only.

    Bins whose bits agree by chance, one in 2**KEPT_BITS of the differing ones, are discounted.
    """
    a, b = F.col(a), F.col(b)
    chance = 1.0 / (1 << KEPT_BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
        .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, text="text", key="doc_id") -> DataFrame:
    """``key`` and fingerprint of every row; one pass, no shuffle. Null texts are empty; equal texts get equal fingerprints."""
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return with_bins(rows, "__text", "__bins").select(F.col("__key").alias(key), packed(F.col("__bins")).alias("fingerprint"))


def with_next(rows: DataFrame, order: str, carried: list[str], ties: str, slices: int) -> DataFrame:
    """``rows`` with the ``carried`` columns of the following row in descending ``order`` as next_<name>.

    The row after the last is the first. The order is cut into ``slices``
    ranges at quantiles; the first row of a range also enters the range before
    it, as its end, so every row meets its successor in one shuffle and no task
    holds more than a range. ``order`` must not be null; equal values follow ``ties``, descending.
    """
    spark = rows.sparkSession
    shares = [i / slices for i in range(1, slices)]
    bounds = rows.agg(F.percentile_approx(order, shares, 100 * slices).alias("b")).first().b if shares else []
    bounds = sorted(set(bounds or []))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col(order))) if bounds else F.lit(0)
    rows = rows.withColumn("__slice", at)
    heads = sorted((r["__slice"], r.head) for r in rows.groupBy("__slice").agg(F.max(order).alias("head")).collect())  # a row a slice
    enters = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    ends = spark.createDataFrame(enters, "__head long, __into int")
    here = F.struct(F.col("__slice").alias("slice"), F.lit(False).alias("end"))
    also = F.struct(F.col("__into").alias("slice"), F.lit(True).alias("end"))
    placed = rows.join(F.broadcast(ends), F.col(order) == F.col("__head"), "left").withColumn(
        "__at", F.explode(F.when(F.col("__into").isNull(), F.array(here)).otherwise(F.array(here, also)))).drop("__slice", "__head", "__into")
    follow = W.partitionBy("__at.slice").orderBy("__at.end", F.desc(order), F.desc(ties))
    return placed.withColumns({f"next_{c}": F.lead(c).over(follow) for c in carried}).filter("NOT __at.end").drop("__at")


def edited_fingerprints(docs: DataFrame, text="text", key="doc_id") -> DataFrame:
    """Fingerprints of every text and of an edited one whose last half comes from the next document.

    The next document is the one with the next smaller ``key``, after the last
    the first; rows that share a key follow their texts, descending. A row with
    a null key has no place in the order: its edited columns and likenesses are null.
    A null text is empty. An empty table gives no rows; other columns are not read. One shuffle of the texts.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    slices = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_next(with_bins(rows.filter("id IS NOT NULL"), "text", "bins"), "id", ["text", "bins"], "text", slices)
    count = F.char_length("text")
    half = F.floor(count / 2).cast("int")
    edited = placed.withColumn("edited", F.concat(F.substring("text", F.lit(1), count - half), F.substring("next_text", F.lit(1), half)))
    done = with_bins(edited, "edited", "edited_bins").select(
        F.col("id").alias(key), count.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"))
    rest = with_bins(rows.filter("id IS NULL"), "text", "bins").select(
        F.col("id").alias(key), count.cast("long").alias("n_chars"), F.lit(None).cast("string").alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), F.lit(None).cast("string").alias("edited_fingerprint"),
        F.lit(None).cast("double").alias("near_edited"), F.lit(None).cast("double").alias("near_next"))
    return done.union(rest)
