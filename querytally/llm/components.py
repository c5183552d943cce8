"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written

MAX_ROUNDS = 50


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the smallest of each u and its v as m.

    The minima are written first: both sides of the join are then dealt anew, and
    a node with very many neighbours can be split among tasks.
    """
    least = written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "w"))
    return pairs.join(least, F.col("u") == F.col("w")).drop("w")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the neighbourhood."""
    return _with_least(_both_ways(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(pairs)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node in ``edges`` (u, v): the smallest node that can be reached.

    Self-links, repeated links and either direction are allowed, nulls are ignored; no links give no rows.
    Each round's links are written to the shared folder; rounds end when the links no longer change.
    """
    edges = written(edges.filter("u <> v").select("u", "v").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        edges = written(_small_star(written(_large_star(edges))))
        now = edges.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
    raise RuntimeError(f"links still changed after {MAX_ROUNDS} rounds")
