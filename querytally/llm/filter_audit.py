"""Audit of filter interaction over all orders, by difference arrays over Lehmer ranks.

Every document has a mask of the filters it fails. An order of the filters is a
permutation, and permutations in lexicographic order have ranks (their Lehmer
code read as a factorial number). All orders that begin with one prefix lie side
by side, so the orders in which a mask is removed at a step by a filter are a
few intervals of ranks: one for each prefix whose last filter is the first that the
mask fails. The count of a mask is added at the start of each interval and taken
off behind its end; one prefix sum over the ranks then gives every total of
every order, and documents are counted once instead of once an order.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3


def text_filters(text="text") -> dict[str, Column]:
    """Failure conditions A to D of a whole text; a null text is empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    capitals = F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > MAX_CAPITAL_PERCENT * F.char_length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def lehmer_rank(prefix, letters) -> int:
    """Rank of the first of all orders of ``letters`` that begin with ``prefix``."""
    left, rank = sorted(letters), 0
    for letter in prefix:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def _prefixes(letters, length):
    if not length:
        return [""]
    return [p + x for p in _prefixes(letters, length - 1) for x in sorted(letters) if x not in p]


def intervals(letters):
    """(mask, first rank, rank behind the last, measure) of everything a document with that mask adds to.

    Measures: ``total`` over all orders, ``fails_X`` and ``only_X`` of a filter
    X over all orders, ``step_i`` where the mask is removed at step i.
    """
    letters, orders, out = sorted(letters), factorial(len(letters)), []
    masks = ["".join(c) for n in range(len(letters) + 1) for c in combinations(letters, n)]
    for mask in masks:
        out.append((mask, 0, orders, "total"))
        out += [(mask, 0, orders, f"fails_{x}") for x in mask]
        out += [(mask, 0, orders, f"only_{mask}")] if len(mask) == 1 else []
    for step in range(1, len(letters) + 1):
        for prefix in _prefixes(letters, step):
            first = lehmer_rank(prefix, letters)
            for mask in masks:
                if prefix[-1] in mask and not set(prefix[:-1]) & set(mask):
                    out.append((mask, first, first + factorial(len(letters) - step), f"step_{step}"))
    return out


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with flags good and toxic.

    A document has a flag if any of its label rows does. Rows without id match
    no label; they are spread by their digest instead of meeting in one partition.
    """
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("l_spread", F.lit(0).cast("long"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    joined = rows.join(flags, (F.col("doc_id") == F.col("l_id")) & (F.col("spread") == F.col("l_spread")), "left")
    return joined.drop("l_id", "l_spread", "spread").fillna(False, ["good", "toxic"])


def mask_counts(docs: DataFrame, labels: DataFrame, text="text", part="lang", key="doc_id", filters=None, copy_filter="E") -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly the filters in ``mask``.

    ``copy_filter`` fails where the same text stands at a smaller id anywhere in
    the table. Each text is read once and becomes a digest; equal rows add up before
    the shuffle, so neither a hot text nor a hot part gathers its rows, and the
    copies of a text are told from its first row by a join on (digest, id).
    """
    filters = filters or text_filters(text)
    fails = F.concat(*[F.when(F.coalesce(c, F.lit(False)), x).otherwise("") for x, c in sorted(filters.items())])
    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), fails.alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy(F.col("digest").alias("f_digest")).agg(F.min("doc_id").alias("f_id"))
    rows = _labelled(rows, labels).join(first, (F.col("digest") == F.col("f_digest")) & (F.col("doc_id") == F.col("f_id")), "left")
    copy = F.col("f_digest").isNull() & F.col("doc_id").isNotNull()
    mask = F.array_join(F.array_sort(F.split(F.concat("mask", F.when(copy, copy_filter).otherwise("")), "")), "")
    return rows.groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _events(spark: SparkSession, letters) -> DataFrame:
    """Both ends of every interval; a fixed table of the filters alone (under 2,000 rows for five)."""
    rows = [
        (mask, rank, measure, sign)
        for mask, first, end, measure in intervals(letters) for rank, sign in ((first, 1), (end, -1))]
    return spark.createDataFrame(rows, "e_mask string, rank int, measure string, sign long")


def audit(counts: DataFrame, letters="ABCDE") -> DataFrame:
    """One row per part, filter order and step, from ``counts`` (part, mask, n, good, toxic).

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley as
    documents within the part, zeros included. The window runs over the ranks of one
    part (120 of five filters), whatever the number of documents. No part gives no row.
    """
    spark, letters = counts.sparkSession, "".join(sorted(letters))
    steps, orders = range(1, len(letters) + 1), factorial(len(letters))
    ends = counts.join(F.broadcast(_events(spark, letters)), F.col("mask") == F.col("e_mask"))

    def change(measure, of="n"):
        return F.sum(F.when(F.col("measure") == measure, F.col("sign") * F.col(of)).otherwise(0))

    sums = {"total": change("total")}
    for x in letters:
        sums |= {f"fails_{x}": change(f"fails_{x}"), f"only_{x}": change(f"only_{x}")}
    for i in steps:
        sums |= {f"removed_{i}": change(f"step_{i}"), f"good_{i}": change(f"step_{i}", "good"), f"toxic_{i}": change(f"step_{i}", "toxic")}
    # every part has a row at every rank: without a change the sum stays as it is
    ranks = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(orders))).alias("rank"))
    changes = ends.groupBy("part", "rank").agg(*[s.alias(c) for c, s in sums.items()])
    changes = ranks.join(changes, ["part", "rank"], "left").fillna(0)
    along = W.partitionBy("part").orderBy("rank")
    totals = changes.select("part", "rank", *[F.sum(c).over(along).alias(c) for c in sums]).filter(F.col("rank") < orders)

    names = sorted(_prefixes(letters, len(letters)))
    order = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("rank") + 1)
    rows = totals.withColumn("filter_order", order).select("*", F.explode(F.array(*[F.struct(
        F.lit(i).alias("step"), F.substring("filter_order", i, 1).alias("letter"),
        (F.col("total") - reduce(Column.__add__, [F.col(f"removed_{j}") for j in range(1, i + 1)])).alias("kept"),
        F.col(f"removed_{i}").alias("removed"), F.col(f"good_{i}").alias("good_lost"), F.col(f"toxic_{i}").alias("toxic_lost"),
    ) for i in steps])).alias("s"))

    def of_letter(measure):
        return F.coalesce(*[F.when(F.col("s.letter") == x, F.col(f"{measure}_{x}")) for x in letters])

    return rows.select(
        "part", "filter_order", "s.step", "s.kept", "s.removed", (of_letter("fails") - F.col("s.removed")).alias("redundant"),
        of_letter("only").alias("unique_fails"), "s.good_lost", "s.toxic_lost",
        F.sum("s.removed").over(W.partitionBy("part", F.col("s.letter"))).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, text="text", part="lang", key="doc_id") -> DataFrame:
    """Audit of the filters A to E over ``docs``.

    A null text is empty, a null part is the part ``''``; a row without id is
    neither a copy nor the first of others and has no label; repeated rows count each; of several
    label rows of a document one with the flag is enough; rows of one id and text are
    no copies of each other. An empty table gives no rows. Columns other than these
    and the labels' doc_id, quality and toxic are not read, whatever their names.
    """
    return audit(mask_counts(docs, labels, text, part, key))


# the same from masks alone: every order and step looks for the masks whose first failing filter stands there
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * len(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS mask
    FROM t LEFT JOIN g ON t.doc_id = g.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h
    WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN len(translate(mask, before || letter, '')) = len(mask) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(mask, letter) AND len(translate(mask, before, '')) = len(mask) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(mask, letter) AND len(translate(mask, before, '')) < len(mask) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(mask, letter) AND len(translate(mask, before, '')) = len(mask) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(mask, letter) AND len(translate(mask, before, '')) = len(mask) THEN toxic ELSE 0 END) AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
