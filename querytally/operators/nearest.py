"""Nearest objects by cosine similarity, exact, for any number of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import written

# A query block stays below this many numbers (8 bytes each).
BLOCK_VALUES = 4_000_000


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _best(query_ids, units, object_ids, vectors, k) -> pd.DataFrame:
    """The k best objects of a block for every query of a block."""
    scores = units @ _unit(vectors).T
    ids = np.asarray(object_ids)
    out = []
    for qid, row in zip(query_ids, scores):
        ok = ~np.isnan(row)
        at, row = ids[ok], row[ok]
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            near = row >= edge - 1e-8  # ties at the edge stay, the final rank decides
            at, row = at[near], row[near]
        order = np.lexsort((at, -np.round(row, 9)))[:k]
        out.append(pd.DataFrame({"query_id": qid, "object_id": at[order], "score": row[order]}))
    return pd.concat(out)


def nearest_objects(queries: DataFrame, objects: DataFrame, k: int, dims: int | None = None, scope: str | None = None,
                    block_values=BLOCK_VALUES, objects_per_block=100_000) -> DataFrame:
    """Top ``k`` of ``objects(object_id, vector)`` per ``queries(query_id, vector)``.

    ``scope`` names a column of both frames, such as the database: a query
    then sees the objects of its own scope only, and a null scope is a scope
    like any other. Rows without a vector are left out. ``dims``, if given, is checked
    against the vectors, which must all be of one length in a scope.

    There is one route at any size: the queries and the objects of each scope
    are dealt into blocks of bounded size, block meets block in a grouped join
    and is scored by a matrix product, and every pair of blocks sends on k rows per query.
    """
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " \
             f"object_id {objects.schema['object_id'].dataType.simpleString()}, score double"
    within = F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit("null")) if scope else F.lit("")
    known = objects.filter("vector is not null").select(within.alias("scope"), "object_id", "vector")
    # named apart, as both frames may come from one table
    asked = queries.filter("vector is not null").select(within.alias("scope"), "query_id", F.col("vector").alias("asked"))
    sides = asked.select("scope", F.size("asked").alias("width"), F.lit(1).alias("q")).union(
        known.select("scope", F.size("vector"), F.lit(0)))
    sizes = sides.groupBy("scope").agg(
        F.sum("q").alias("n"), F.count_if(F.col("q") == 0).alias("m"), F.min("width").alias("narrow"), F.max("width").alias("width")).filter("n > 0 AND m > 0")
    wrong = F.col("width") != F.col("narrow")
    if dims is not None:
        wrong = wrong | (F.col("width") != dims)
    per_block = F.greatest(F.lit(1), F.floor(F.lit(block_values) / F.greatest(F.lit(1), "width")))
    blocks = sizes.select(
        F.col("scope").alias("s"), F.when(wrong, F.raise_error(F.lit("vectors of several lengths")).cast("long"))
        .otherwise(F.ceil(F.col("n") / per_block)).alias("q_blocks"), F.ceil(F.col("m") / F.lit(objects_per_block)).alias("o_blocks"))
    blocks = written(blocks)
    one = blocks.first() if scope is None else None  # all rows are one scope: no join is needed to tell its blocks

    def dealt(rows, key, own, own_blocks, other, other_blocks):
        if scope is None:
            sized = rows.withColumns({n: F.lit(one[n] if one else 0) for n in ("q_blocks", "o_blocks")})
        else:
            sized = rows.join(blocks, F.col("scope") == F.col("s"))
        return sized.filter("q_blocks > 0").withColumn(own, F.pmod(F.xxhash64(key), F.col(own_blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1))).drop("s", "q_blocks", "o_blocks")

    def score(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"][:0], "object_id": right["object_id"][:0],
                                 "score": pd.Series([], dtype="float64")})
        return _best(left["query_id"], _unit(left["asked"]), right["object_id"], right["vector"], k)

    keys = ["scope", "qb", "ob"]
    near = dealt(asked, "query_id", "qb", "q_blocks", "ob", "o_blocks").groupBy(*keys).cogroup(
        dealt(known, "object_id", "ob", "o_blocks", "qb", "q_blocks").groupBy(*keys)).applyInPandas(score, schema)
    ranked = F.row_number().over(
        W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("object_id").asc()))
    return near.withColumn("rank", ranked).filter(F.col("rank") <= k)
