"""Selecting, sampling, pruning and numbering evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .nearest import nearest_objects
from .numbering import number_rows, number_within, padded_names


def select_cases(cases: DataFrame, dataset=None, database=None, name=None) -> DataFrame:
    """Cases of a data set, database and / or name; 'all' and None mean any."""
    for column, wanted in (("dataset", dataset), ("database", database), ("name", name)):
        if wanted not in (None, "all"):
            cases = cases.filter(F.col(column) == wanted)
    return cases


def review_candidates(results: DataFrame, which: str) -> DataFrame:
    """Results to look at again: 'fail' the failed, 'all' every judged one."""
    if which == "none":
        return results.limit(0)
    judged = results.filter(F.col("status").isin("pass", "fail"))
    return judged if which == "all" else judged.filter(F.col("status") == "fail")


def sample_evenly(cases: DataFrame, group: str, order: list, size=50) -> DataFrame:
    """At most ``size`` evenly spaced rows per group, first and last included.

    Position round(i * (n - 1) / (size - 1)) for i = 0 .. size-1, ties to even;
    ``order`` is unique in its group.
    """
    counts = cases.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    step = (F.col("__n") - 1) / F.lit(float(size - 1))
    picks = counts.select(
        group,
        F.explode(F.when(
            F.col("__n") > size,
            F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * step).cast("long")),
        ).otherwise(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).alias("__pick"),
    )
    # only the keys are sorted; the few picked ones select the full rows
    placed = number_within(cases.select(group, *order), [group], order, "__pick", start=0)
    picked = placed.join(picks, [group, "__pick"], "left_semi").drop("__pick")
    return cases.join(picked, [group, *order], "left_semi")


def prefix_match(entries: DataFrame, wanted: list[str], faithful=False) -> DataFrame:
    """Entries whose '{dataset}_{database}' starts with a wanted prefix.

    ``wanted`` is a list or, for any number of prefixes, a frame with a column ``prefix``.
    ``faithful`` repeats an entry for each prefix it matches, as often as that is wanted. Null
    prefixes match nothing.

    The prefixes are joined by equality with the beginnings of each key, of the lengths that occur:
    a key has as many beginnings as there are lengths, whatever the number of prefixes.
    """
    spark = entries.sparkSession
    if not isinstance(wanted, DataFrame):
        wanted = spark.createDataFrame([(w.strip(),) for w in wanted], "prefix string")
    counted = wanted.select(F.trim("prefix").alias("__prefix")).filter("__prefix IS NOT NULL").groupBy("__prefix").agg(
        F.count(F.lit(1)).alias("__times"))
    lengths = sorted(r["n"] for r in counted.select(F.char_length("__prefix").alias("n")).distinct().collect())  # a few numbers
    key = F.concat_ws("_", "dataset", "database")
    # keys recur: each is cut once, and joins back as one row
    keys = entries.select(key.alias("__key")).distinct()
    cuts = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    begun = keys.select("__key", F.explode(F.filter(cuts, lambda n: n <= F.char_length("__key"))).alias("__n"))
    hits = begun.withColumn("__prefix", F.expr("left(__key, __n)")).join(counted, "__prefix").groupBy("__key").agg(F.sum("__times").alias("__times"))
    found = entries.withColumn("__key", key).join(hits, "__key")
    if faithful:
        found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return found.select(*[F.col(f"`{c}`") for c in entries.columns])


def prune_orphans(cases: DataFrame, databases: DataFrame) -> DataFrame:
    """Cases whose (dataset, database) is known."""
    return cases.join(_known(databases), ["dataset", "database"], "left_semi")


def orphans(cases: DataFrame, databases: DataFrame) -> DataFrame:
    return cases.join(_known(databases), ["dataset", "database"], "left_anti")


def _known(databases: DataFrame) -> DataFrame:
    return databases.select("dataset", "database").distinct()


def append_in_order(*files: DataFrame, order="file_no") -> DataFrame:
    """Bag union of question files, keeping which file a row came from."""
    out = None
    for i, f in enumerate(files):
        part = f.withColumn(order, F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def renumber(cases: DataFrame, order: list, name="name") -> DataFrame:
    """New names: running number from 1, zero-padded to the total's width."""
    return padded_names(number_rows(cases, order, "n"), "n", name)


def exact_objects(objects: DataFrame, wanted: DataFrame, schema="public", scope: str | None = None) -> DataFrame:
    """Table objects a case names: ``objects(id, objtype, objnames)`` against
    ``wanted(..., tables)``; one row per (case, object)."""
    named = wanted.withColumn("__t", F.explode(F.array_distinct("tables"))).drop("tables")
    tables = objects.filter(
        (F.col("objtype") == "table") & (F.try_element_at("objnames", F.lit(1)) == schema)
    )
    own = [scope] if scope else []
    tables = tables.select("id", F.try_element_at("objnames", F.lit(2)).alias("__t"), *own)
    return named.join(tables, ["__t", *own]).drop("__t")


def context_objects(mode: str, objects: DataFrame, cases: DataFrame, k=10, dims=576,
                    scope: str | None = None) -> DataFrame:
    """(case, object) pairs a case is answered with.

    'entire_catalog': one row per object, the same for all cases, so no case
    column; 'semantic_search': the ``k`` nearest by ``vector``; 'specific_ids':
    those named in ``tables``. Cases carry ``query_id``; ``scope`` names the
    column, such as the database, whose objects a case may see.
    """
    if mode == "entire_catalog":
        return objects.select("id")
    own = [scope] if scope else []
    if mode == "specific_ids":
        return exact_objects(objects, cases.select("query_id", "tables", *own), scope=scope).select("query_id", "id")
    if mode != "semantic_search":
        raise ValueError(f"unknown context mode: {mode}")
    near = nearest_objects(
        cases.select("query_id", "vector", *own), objects.select(F.col("id").alias("object_id"), "vector", *own), k, dims, scope)
    return near.select("query_id", F.col("object_id").alias("id"), "score", "rank")


def context_mode(mode: str) -> Column:
    """Run details derived from the context mode."""
    return F.struct(
        F.lit(mode).alias("context_mode"),
        F.lit(mode == "entire_catalog").alias("entire_schema"),
        F.lit(mode == "specific_ids").alias("gold_tables"),
    )
