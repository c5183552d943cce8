"""From comparison outcomes to statuses, costs and per-data-set figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import int_div, pass_ratio
from ..functions.table_names import referenced_tables
from .compare import _large_cases, _parts, table_sets_match
from .joins import lookup_with_fallback
from .numbering import number_within

# Token counters of a case and the price that applies to each.
COUNTERS = {"cached_tokens": "cached", "request_tokens": "input", "response_tokens": "output"}


# What a flagged expected query is reported with.
FAILED_QUERY, EMPTY_RESULT = "Failed to execute query: ", "No results"


def status(passed, candidate_error) -> Column:
    """'error' when the candidate failed, else by the comparison."""
    return F.when(candidate_error.isNotNull(), F.lit("error")).when(passed, F.lit("pass")).otherwise(F.lit("fail"))


def scored(outcomes: DataFrame) -> DataFrame:
    """Add ``status``; cases whose expected query failed leave the set.

    ``outcomes`` has passed, golden_error and candidate_error.
    """
    kept = outcomes.filter(F.col("golden_error").isNull())
    return kept.withColumn("status", status(F.col("passed"), F.col("candidate_error"))).drop("passed", "golden_error")


def with_costs(cases: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per token counter: price of ``model``, else of 'provider/model',
    else 0. ``prices(model, cached, input, output)`` is per token."""
    lists = list(COUNTERS.values())
    priced = lookup_with_fallback(
        cases, prices, F.col("model"), F.concat_ws("/", "provider", "model"), "model", lists)
    for counter, price in COUNTERS.items():
        priced = priced.withColumn(
            f"{counter}_cost", F.coalesce(F.coalesce(counter, F.lit(0)) * F.col(price), F.lit(0.0)).cast("double"))
    return priced.drop(*lists)


def usage_sums() -> list[Column]:
    """Sums of the token counters and costs; cases without usage add nothing."""
    out = []
    for counter in COUNTERS:
        out.append(F.coalesce(F.sum(counter), F.lit(0)).alias(counter))
        out.append(F.round(F.coalesce(F.sum(f"{counter}_cost"), F.lit(0.0)), 8).alias(f"{counter}_cost"))
    return out


def totals() -> list[Column]:
    passing, total = F.count_if(F.col("status") == "pass"), F.count(F.lit(1))
    return [
        passing.alias("passing"), total.alias("total"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "error").alias("errored"),
        F.round(F.sum("duration"), 3).alias("total_duration"),
        pass_ratio(passing, total).alias("ratio"),
    ]


def dataset_rollup(evals: DataFrame, usage=False) -> DataFrame:
    """Figures per data set; every aggregate combines before the shuffle."""
    return evals.groupBy("dataset").agg(*totals(), *(usage_sums() if usage else []))


def overall_rollup(evals: DataFrame, usage=False) -> DataFrame:
    """The same figures per data set and over all, in one pass."""
    return (
        evals.rollup("dataset").agg(F.grouping("dataset").alias("g"), *totals(), *(usage_sums() if usage else []))
        .withColumn("level", F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.lit("dataset"))).drop("g")
    )


def error_histogram(evals: DataFrame) -> DataFrame:
    """Number of errors per data set and exception class."""
    return (
        evals.filter(F.col("status") == "error")
        .groupBy("dataset", "exception_class").agg(F.count(F.lit(1)).alias("n"))
    )


def histogram_map(histogram: DataFrame) -> DataFrame:
    """One map per data set; its size is the number of exception classes."""
    entries = F.array_sort(F.collect_list(F.struct("exception_class", "n")))
    return histogram.groupBy("dataset").agg(F.map_from_entries(entries).alias("failed_error_counts"))


def name_lists(evals: DataFrame, group: list, name="name", per_piece=1000) -> DataFrame:
    """Sorted names per group, in numbered pieces of bounded length.

    A group may hold any share of the rows: its list continues over as many
    pieces as it needs, and no task ever holds more than one piece per row.
    """
    placed = number_within(evals.select(*group, name), group, [name], "__n", start=0)
    piece = int_div("__n", F.lit(per_piece)).alias("piece")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__n", name))), lambda r: r[name])
    return placed.groupBy(*group, piece).agg(listed.alias("names"))


def score_map(figures: DataFrame, run: list) -> DataFrame:
    """JSON text '{dataset: {passing, total}}' per run, from rolled-up figures."""
    entry = F.struct("dataset", F.struct("passing", "total").alias("score"))
    return figures.groupBy(*run).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("scores"))


def timing_stats(timings: DataFrame, seconds="seconds") -> DataFrame:
    """Count, mean, maximum and minimum per data set."""
    return timings.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg(seconds), 5).alias("avg_time"),
        F.round(F.max(seconds), 5).alias("max_time"),
        F.round(F.min(seconds), 5).alias("min_time"),
    )


def overall_timing(stats: DataFrame) -> DataFrame:
    """Over data sets: the average is the mean of the averages."""
    return stats.agg(
        F.sum("total").alias("total"), F.avg("avg_time").alias("avg_time"),
        F.max("max_time").alias("max_time"), F.min("min_time").alias("min_time"))


def golden_validation(outcomes: DataFrame) -> DataFrame:
    """Flag expected queries that failed or returned nothing.

    ``outcomes(dataset, database, name, n_rows, error, ...)``.
    """
    problem = F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED_QUERY), F.col("error"))) \
        .when(F.col("n_rows") == 0, F.lit(EMPTY_RESULT))
    return outcomes.withColumn("problem", problem).withColumn("flagged", problem.isNotNull())


def with_expected_tables(cases: DataFrame) -> DataFrame:
    """``cases`` with the sorted names of the tables that their ``query`` reads."""
    return cases.withColumn("expected_tables", F.array_sort(referenced_tables("query")))


def score_tables(cases: DataFrame, strict=False) -> DataFrame:
    """Status of table identification: the expected query's tables against
    the ``predicted`` list of names. Tables that are there already are not taken from the text again."""
    named = cases if "expected_tables" in cases.columns else with_expected_tables(cases)
    hit = table_sets_match(F.col("predicted"), F.col("expected_tables"), strict)
    return named.withColumn("status", status(hit, F.lit(None)))


def first_rows(rows: DataFrame, keys: list, n=10) -> DataFrame:
    """First ``n`` rows of each side of each case, by row id.

    Rows go to tasks of a bounded number before they are sorted, as a read task may have any number: those of a
    case of usual size side by side, which takes one shuffle; those of larger ones anywhere, and the rank limit
    runs there before the next shuffle, so a task sends at most ``n`` rows of any result. ``rows`` is read several
    times and should be stored.
    """
    w = W.partitionBy(*keys, "side").orderBy("row_id")

    def ranked(dealt):
        return dealt.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

    large, parts = _large_cases(rows, keys), _parts(rows, rows.count())
    n_large = large.agg(F.sum("n")).first()[0]
    if n_large is None:
        return ranked(rows.repartition(parts, *keys))
    few = F.broadcast(large.select(*keys))
    spread = rows.join(few, keys, "left_semi").repartition(_parts(rows, n_large), *keys, "row_id", "cells")
    return ranked(rows.join(few, keys, "left_anti").repartition(parts, *keys)).unionByName(ranked(spread))


def review_sample(cases: DataFrame, rows: DataFrame, keys: list, n=10, headers: DataFrame | None = None) -> DataFrame:
    """One review text per case: question, both queries, first rows of each.

    With ``headers`` (keys, side, names) the rows come under their column headings.
    """
    def shown(cells):
        return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")

    rows = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))  # no case has such a key
    # ranked first: a join on the case keys would gather a large result's rows
    heads = first_rows(rows, keys, n).join(cases.select(*keys), keys, "left_semi").select(*keys, "side", "rank", shown("cells").alias("line"))
    if headers is not None:
        named = headers.join(cases.select(*keys), keys, "left_semi").filter("names IS NOT NULL")
        heads = heads.unionByName(named.select(*keys, "side", F.lit(0).alias("rank"), shown("names").alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"])
    tables = heads.groupBy(*keys, "side").agg(F.array_join(lines, "\n").alias("t"))
    both = tables.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "expected", F.col("t"))).alias("expected_rows"),
        F.max(F.when(F.col("side") == "actual", F.col("t"))).alias("actual_rows"))
    blank = F.lit("")
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Question: "), F.col("question")),
        F.concat(F.lit("Expected query:\n"), F.col("expected_query")),
        F.concat(F.lit("Expected rows:\n"), F.coalesce("expected_rows", blank)),
        F.concat(F.lit("Actual query:\n"), F.col("generated_query")),
        F.concat(F.lit("Actual rows:\n"), F.coalesce("actual_rows", blank)),
    )
    return cases.join(both, keys, "left").withColumn("review", text)


def case_record(cases: DataFrame, comparison: DataFrame, keys: list) -> DataFrame:
    """The full record of a case: status and a nested ``details`` struct.

    A case with an ``exception_class`` has status 'error' and carries class,
    message and trace; one without error and comparison has no status yet.
    """
    joined = cases.join(comparison.withColumnRenamed("passed", "__passed"), keys, "left")
    failure = [c for c in ("exception_class", "exception", "trace") if c in cases.columns]
    optional = [c for c in ("gold_tables", "llm_judge", "llm_explanation", "messages") if c in cases.columns] + failure
    error = F.col("exception_class") if "exception_class" in cases.columns else F.lit(None)
    usage = F.struct(*[c for k in COUNTERS for c in (k, f"{k}_cost")])
    return joined.select(
        *keys, "question", "duration",
        F.when(error.isNotNull() | F.col("__passed").isNotNull(), status(F.col("__passed"), error)).alias("status"),
        F.struct("generated_query", "expected_query", "duration", usage.alias("usage"), *optional).alias("details"),
    )
