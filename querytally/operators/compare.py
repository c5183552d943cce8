"""Equality of query results, ignoring row order, column order and names.

All cases are compared in one pass over their rows. Columns are matched by
order-free fingerprints; matched rows are then compared exactly as multisets.
The rows of a case of usual size are brought together, many cases to a task and a
bounded number of rows, so that all steps of a pass take one shuffle. Cases of
more than ``CASE_ROWS`` rows are spread: their fingerprints combine map-side,
so one holding most of the rows costs no more than one partial aggregate per task, and
their rows are compared by content.

Two readings of the matching exist:

* default: true when some one-to-one column assignment makes the rows equal;
* ``faithful``: every expected column takes the first equal actual column, a
  later expected column overwrites an earlier one, and the lost column makes
  the result false, also for identical frames with two equal columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordering import pg_asc
from ..session import written
from .components import components
from .matching import unmatched_groups
from .numbering import number_within
from .ordered import chunked, running_sum
from .results import ACTUAL, EXPECTED, result_header, result_rows, with_unique_names

# Tolerance of float comparison.
ABSOLUTE, RELATIVE = 1e-8, 1e-5

CASE_ROWS = 100_000  # rows of a case, both sides, that may meet in one task; larger cases are spread
TASK_ROWS = 250_000  # rows of a task that has several cases
_SALTS = 8
_BEAM = 64
PART_ROWS = 2000  # rows of a part, each side, that one task matches; larger parts are matched by joins
_LOW = (1 << 22) - 1


def spread_join(rows: DataFrame, per_case: DataFrame, keys: list) -> DataFrame:
    """Join rows to one record per case without gathering a case in one task.

    The salt splits a hot case, and because the output is then partitioned by
    (keys, salt) a later grouping on (keys, row content) has to shuffle by its
    own keys instead of staying on the case's partition; adaptive skew
    splitting may also cut the salted partitions further.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("row_id", "cells"), F.lit(_SALTS)))
    copies = per_case.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {_SALTS - 1}L)")))
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def _parts(df: DataFrame, n: int, size: int | None = None) -> int:
    """Tasks for ``n`` rows, ``size`` to a task (default ``TASK_ROWS``)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // (size or TASK_ROWS)))


def _large_cases(rows: DataFrame, keys: list) -> DataFrame:
    """Cases of more than ``CASE_ROWS`` rows and their number ``n``."""
    return written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CASE_ROWS))


def _with_case(rows: DataFrame, per_case: DataFrame, keys: list, parts: int | None) -> DataFrame:
    """Join rows to one record per case: a case's rows side by side in one of ``parts`` tasks, without ``parts`` spread.

    Groupings by the keys and more need no further shuffle where the rows are side by side.
    """
    if parts is None:
        return spread_join(rows, per_case, keys)
    return rows.repartition(parts, *keys).join(per_case.repartition(parts, *keys), keys)


def _numbered(df: DataFrame, group: list, order: list, parts: int | None) -> DataFrame:
    """Row numbers ``n`` within groups, which are in one task each where there are ``parts``."""
    if parts is None:
        return number_within(df, group, order)
    by = W.partitionBy(*group).orderBy(*[pg_asc(o) if isinstance(o, str) else o for o in order])
    return df.withColumn("n", F.row_number().over(by).cast("long"))


def _order_free(h: Column) -> list[Column]:
    """Sum of 64-bit hashes in three parts that cannot overflow a bigint."""
    return [
        F.sum(h.bitwiseAND(F.lit(_LOW))),
        F.sum(F.shiftrightunsigned(h, 22).bitwiseAND(F.lit(_LOW))),
        F.sum(F.shiftrightunsigned(h, 44)),
    ]


def column_profile(headers: DataFrame, rows: DataFrame, keys: list) -> DataFrame:
    """One row per (case, side, column): content class and float statistics.

    ``class`` is equal exactly for columns with the same kind, length, null
    count and multiset of values (up to hash collisions, which the later row
    check would expose). A column without values has no type.
    """
    valued = rows.select(*keys, "side", "kinds", F.posexplode("cells").alias("pos", "cell")).select(
        *keys, "side", "pos", F.expr("substring(kinds, pos + 1, 1)").alias("kind"), "cell", F.lit(1).alias("w"))
    # a header adds its columns without a value, so an empty result has them too
    declared = headers.select(*keys, "side", F.posexplode(F.expr(
        "transform(sequence(1, length(kinds)), i -> substring(kinds, i, 1))")).alias("pos", "kind")
    ).filter("kind <> ''").select("*", F.lit(None).cast("string").alias("cell"), F.lit(0).alias("w"))
    number = F.when(F.col("kind") == "f", F.col("cell").try_cast("double"))
    parts = _order_free(F.when(F.col("w") == 1, F.xxhash64("cell")))
    measured = valued.unionByName(declared).groupBy(*keys, "side", "pos").agg(
        F.max(F.ascii("kind")).alias("letter"), F.sum("w").alias("n"), F.count("cell").alias("filled"),
        *[p.alias(f"fp{i}") for i, p in enumerate(parts)],
        F.min(number).alias("low"), F.max(number).alias("high"),
        F.sum(number).alias("total"), F.sum(F.abs(number)).alias("mass"),
    )
    declared = F.when(F.col("letter") == 0, F.lit("")).otherwise(F.char("letter"))  # numbers aggregate without a sort
    kind = F.when(F.col("filled") == 0, F.lit("n")).otherwise(declared)
    return measured.select(
        *keys, "side", "pos", kind.alias("kind"), "n", "filled",
        F.xxhash64(kind, "n", "filled", *[F.coalesce(f"fp{i}", F.lit(0)) for i in range(3)]).alias("class"),
        "low", "high", "total", "mass",
    )


def _within(left, right) -> Column:
    """|left - right| inside the tolerance around ``right``; NaN and infinities agree with themselves only."""
    near = F.abs(left - right) <= F.lit(ABSOLUTE) + F.lit(RELATIVE) * F.abs(right)
    return (left == right) | ((F.abs(right) < F.lit(float("inf"))) & near)


def _near(x: Column, y: Column) -> Column:
    """Whether two unequal float columns could agree within the tolerance:
    length, null count, minimum, maximum and sum must fit."""
    slack = x["n"] * ABSOLUTE + 2 * RELATIVE * (x["mass"] + y["mass"])
    odd = F.isnan(x["total"]) | F.isnan(y["total"]) | (F.abs(x["total"]) == F.lit(float("inf")))
    return F.coalesce(
        (x["kind"] == "f") & (y["kind"] == "f") & (x["class"] != y["class"])
        & (x["n"] == y["n"]) & (x["filled"] == y["filled"])
        & _within(x["low"], y["low"]) & _within(x["high"], y["high"])
        & (odd | (F.abs(x["total"] - y["total"]) <= slack)), F.lit(False))


def _per_case(columns: DataFrame, keys: list) -> DataFrame:
    """One row per case: its columns on both sides and who may match whom.

    The lists are as long as a result is wide, so matching is array work
    inside the row and needs no join between columns.
    """
    fields = ["pos", "kind", "n", "filled", "class", "low", "high", "total", "mass"]
    listed = F.collect_list(F.struct("side", *fields))
    cases = columns.groupBy(*keys).agg(F.array_sort(listed).alias("__c"))
    for name, side in (("a", ACTUAL), ("e", EXPECTED)):
        cases = cases.withColumn(name, F.filter("__c", lambda x: x["side"] == side))
    alike = F.transform("e", lambda x: F.transform(
        F.filter("a", lambda y: y["class"] == x["class"]), lambda y: y["pos"]))
    near = F.transform("e", lambda x: F.transform(F.filter("a", lambda y: _near(x, y)), lambda y: y["pos"]))
    return cases.drop("__c").withColumn("alike", alike).withColumn("near", near)


def _verified_pairs(rows: DataFrame, pairs: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """Pairs whose sorted values agree position by position."""
    lists = pairs.groupBy(*keys).agg(F.collect_list(F.struct("e_pos", "a_pos")).alias("pairs"))
    expected = F.col("side") == EXPECTED
    values = (
        _with_case(rows, lists, keys, parts)
        .select(*keys, "side", "row_id", F.explode(F.transform("pairs", lambda p: F.struct(
            p["e_pos"].alias("e_pos"), p["a_pos"].alias("a_pos"),
            F.get("cells", F.when(expected, p["e_pos"]).otherwise(p["a_pos"])).try_cast("double").alias("v")))).alias("c"))
        .select(*keys, "side", "row_id", "c.*").filter("v is not null")
    )
    ranked = _numbered(values, [*keys, "e_pos", "a_pos", "side"], ["v", "row_id"], parts)
    off = (
        ranked.groupBy(*keys, "e_pos", "a_pos", "n")
        .agg(F.max(F.when(expected, F.col("v"))).alias("ev"), F.max(F.when(~expected, F.col("v"))).alias("av"))
        .filter(~_within(F.col("ev"), F.col("av"))).select(*keys, "e_pos", "a_pos").distinct()
    )
    return pairs.join(off, [*keys, "e_pos", "a_pos"], "left_anti")


def _refined(rows: DataFrame, cases: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """Narrow equal columns by how their values line up in rows.

    Every row gets a signature from its (class, value) pairs in any column
    order; a column's new class also counts the signatures its values meet.
    Twins are columns that are the same row by row. Adds the narrowed
    ``alike`` and, per column, ``a_twin``, ``e_twin`` and ``e_class``.
    """
    def marks(side):
        def mark(x):
            here = F.size(F.filter("a", lambda y: y["class"] == x["class"]))
            there = F.size(F.filter("e", lambda y: y["class"] == x["class"]))
            return F.when((here == there) & (x["kind"] != "f"), x["class"])
        return F.transform(side, mark)

    sides = cases.select(*keys, F.explode(F.array(
        F.struct(F.lit(ACTUAL).alias("side"), marks("a").alias("marks")),
        F.struct(F.lit(EXPECTED).alias("side"), marks("e").alias("marks")))).alias("m")).select(*keys, "m.*")
    marked = F.filter(
        F.zip_with("marks", "cells", lambda m, c: F.struct(m.alias("m"), c.alias("c"))),
        lambda p: p["m"].isNotNull())
    signed = _with_case(rows, sides, [*keys, "side"], parts).withColumn("sign", F.xxhash64(F.array_sort(marked)))
    cells = signed.select(*keys, "side", "row_id", "sign", F.posexplode("cells").alias("pos", "cell"))
    met, place = _order_free(F.xxhash64("sign", "cell")), _order_free(F.xxhash64("row_id", "cell"))
    seen = (
        cells.groupBy(*keys, "side", "pos").agg(*[p.alias(f"m{i}") for i, p in enumerate(met)],
                                                *[p.alias(f"p{i}") for i, p in enumerate(place)])
        .select(*keys, "side", "pos", F.xxhash64("m0", "m1", "m2").alias("met"), F.xxhash64("p0", "p1", "p2").alias("place"))
        .groupBy(*keys).agg(F.collect_list(F.struct("side", "pos", "met", "place")).alias("seen")))
    out = cases.join(seen, keys, "left")
    for name, side in (("a", ACTUAL), ("e", EXPECTED)):
        out = out.withColumn(name, F.transform(name, _column_classes(side)))
    narrowed = F.transform("e", lambda x: F.transform(
        F.filter("a", lambda y: y["class"] == x["class"]), lambda y: y["pos"]))
    return (
        out.withColumn("alike", narrowed).withColumn("a_twin", F.col("a.twin")).withColumn("e_twin", F.col("e.twin"))
        .withColumn("e_class", F.col("e.class")).drop("seen"))


def _column_classes(side: str):
    def narrowed(x):
        mine = F.get(F.filter("seen", lambda s: (s["side"] == side) & (s["pos"] == x["pos"])), F.lit(0))
        return F.struct(
            x["pos"].alias("pos"),
            F.when(x["kind"] == "f", x["class"]).otherwise(F.xxhash64(x["class"], mine["met"])).alias("class"),
            F.xxhash64(x["class"], mine["place"]).alias("twin"))

    return narrowed


def _exact_matches(rows: DataFrame, attempts: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """Attempts whose projected rows are the same multiset on both sides."""
    tagged = _with_case(rows, attempts, keys, parts)
    projected = F.when(
        F.col("side") == ACTUAL, F.transform("mapping", lambda p: F.get("cells", p))
    ).otherwise(F.col("cells"))
    weight = F.when(F.col("side") == ACTUAL, F.lit(1)).otherwise(F.lit(-1))
    off = (
        tagged.select(*keys, "attempt", projected.alias("line"), weight.alias("w"))
        .groupBy(*keys, "attempt", "line").agg(F.sum("w").alias("w"))
        .filter("w <> 0").select(*keys, "attempt").distinct()
    )
    return attempts.join(off, [*keys, "attempt"], "left_anti")


def _hashed_matches(rows: DataFrame, attempts: DataFrame, keys: list, sharp=None, parts: int | None = None) -> DataFrame:
    """As above, by two order-free 64-bit row fingerprints; groups no rows by content.

    With ``sharp`` (an array of flags) a mapping may be a beginning only, and
    just its flagged columns are looked at.
    """
    tagged = _with_case(rows, attempts, keys, parts)
    if sharp is None:
        line = F.when(
            F.col("side") == ACTUAL, F.transform("mapping", lambda p: F.get("cells", p))
        ).otherwise(F.col("cells"))
    else:
        places = F.transform("mapping", lambda p, i: F.when(F.get(sharp, i), F.when(F.col("side") == ACTUAL, p).otherwise(i)))
        line = F.transform(F.filter(places, lambda p: p.isNotNull()), lambda p: F.get("cells", p))
    # a hash skips nulls, so each value goes in together with a flag
    line = F.transform(line, lambda c: F.struct(c.isNotNull(), c))
    sides = {ACTUAL: [], EXPECTED: []}
    for side, out in sides.items():
        here = F.col("side") == side
        for seed in (1, 2):
            h = F.when(here, F.xxhash64(F.lit(seed), F.col("line")))
            out.extend(F.coalesce(p, F.lit(0)) for p in _order_free(h))
        out.append(F.count_if(here))
    off = (
        tagged.select(*keys, "attempt", "side", line.alias("line")).groupBy(*keys, "attempt")
        .agg(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(sides[ACTUAL])]).alias("a"),
             F.struct(*[c.alias(f"c{i}") for i, c in enumerate(sides[EXPECTED])]).alias("e"))
        .filter(F.col("a") != F.col("e")).select(*keys, "attempt")
    )
    return attempts.join(off, [*keys, "attempt"], "left_anti")


def _assigned(rows: DataFrame, choice: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """Column assignments of the few cases where classes alone leave a choice.

    Assignments grow by one expected column at a time, and a beginning lives on
    only while the rows agree in the columns it has, so a wrong start ends at
    once. Columns that are the same row by row are taken in order. Of the beginnings of a
    case up to ``_BEAM`` go on together and the others wait; they get their
    turn unless the case is settled by then, so none is lost.
    """
    fields = [*keys, "cands", "alike", "a_twin"]
    mapping, used = F.col("mapping"), lambda p: F.array_contains("mapping", p)
    waiting = [choice.select(*fields, F.array().cast("array<int>").alias("mapping"))]
    found = None
    while waiting:
        front = waiting.pop()
        if found is not None:
            front = front.join(found.filter("settled").select(*keys).distinct(), keys, "left_anti")
        ranked = written(front.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy("mapping"))))
        rest = ranked.filter(F.col("turn") > _BEAM)
        if not rest.isEmpty():
            waiting.append(rest.drop("turn"))
        options = F.filter(F.get("cands", F.size(mapping)), lambda p: ~used(p) & ~F.exists(
            F.get("cands", F.size(mapping)), lambda q: (q < p) & ~used(q) & (F.get("a_twin", q) == F.get("a_twin", p))))
        tries = ranked.filter(F.col("turn") <= _BEAM).drop("turn").withColumn("next", F.explode(options)).withColumn(
            "mapping", F.concat("mapping", F.array("next"))).drop("next").withColumn("attempt", F.xxhash64("mapping"))
        sharp = F.transform("mapping", lambda p, i: F.array_contains(F.get("alike", i), p))
        kept = written(_hashed_matches(rows, tries.withColumn("sharp", sharp), keys, "sharp", parts))
        whole = F.size("mapping") == F.size("cands")
        done = kept.filter(whole).select(*keys, "attempt", "mapping", F.forall("sharp", lambda x: x).alias("settled"))
        found = done if found is None else found.unionByName(done)
        more = kept.filter(~whole).drop("attempt", "sharp")
        if not more.isEmpty():
            waiting.append(more)
    return found.drop("settled")


def _float_steps(tagged: DataFrame, keys: list) -> DataFrame:
    """Add ``steps``: for each float column of a row the number of its value's step.

    A step is a run of values, of both sides, with no gap beyond the tolerance. Values are numbered
    over range slices, so neither a case nor a column has to fit a task.
    """
    column = [*keys, "attempt", "pos"]
    cells = tagged.select(*keys, "attempt", "side", "row_id", "kinds", F.posexplode("line").alias("pos", "cell")).filter(
        "substring(kinds, pos + 1, 1) = 'f'").select(*column, "side", "row_id", F.col("cell").try_cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    numbered = number_within(cells.select(*column, "v").distinct(), column, ["v"], "n", start=0)
    before = numbered.select(*column, (F.col("n") + 1).alias("n"), F.col("v").alias("before"))
    apart = F.col("v") - F.col("before") > F.lit(ABSOLUTE) + F.lit(RELATIVE) * F.greatest(F.abs("v"), F.abs("before"))
    joined = chunked(numbered.join(before, [*column, "n"], "left"), "n")
    steps = running_sum(joined, column, "n", F.coalesce(apart, F.lit(False)).cast("long"), "step").select(*column, "v", "step")
    per_row = cells.join(steps, [*column, "v"]).groupBy(*keys, "attempt", "side", "row_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("steps"))
    return tagged.join(per_row, [*keys, "attempt", "side", "row_id"], "left")


def _agree() -> Column:
    """The rows ``al`` and ``el`` agree in each column, floats within the tolerance."""
    return F.expr(f"""
        forall(sequence(0, size(el) - 1), i -> (al[i] <=> el[i]) or (
            substring(kinds, i + 1, 1) = 'f' and al[i] is not null and el[i] is not null
            and abs(cast(el[i] as double)) < double('Infinity') and abs(cast(al[i] as double) - cast(el[i] as double))
                <= {ABSOLUTE}D + {RELATIVE}D * abs(cast(el[i] as double))))""")


def _cell_node(case) -> Column:
    return F.xxhash64(*case, "range", F.col("cells"))


def _with_neighbour_cells(df: DataFrame) -> DataFrame:
    """A row for each cell around ``cells``, itself included; a null stays."""
    steps = F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1)))
    for i in range(3):
        moved = F.transform("cells", lambda x, at: F.when(at == F.lit(i), x + F.col("step")).otherwise(x))
        df = df.withColumn("step", F.explode(F.when(F.get("cells", F.lit(i)).isNull(), F.array(F.lit(0).cast("long"))).otherwise(steps))).withColumn(
            "cells", moved).drop("step")
    return df


def _with_part(rows: DataFrame, keys: list) -> DataFrame:
    """Add ``part``: rows that may pair up, or that a chain of such pairs links, have the same; also ``cells`` and ``node``.

    Floats are put on a scale on which the tolerance is one everywhere and cut into cells; rows that agree are in the
    same or in neighbouring cells. Cells, not rows, are linked, by the three float columns with the most cells.
    """
    case = [*keys, "attempt"]
    # the integral of 1 / tolerance; a little more than one wide, as the tolerance changes between two values
    cell = f"""case when substring(kinds, i + 1, 1) = 'f' and c is not null then cast(floor(signum(try_cast(c as double))
        * ln(1 + least(abs(try_cast(c as double)), 1e300D) * {RELATIVE / ABSOLUTE}D) / {RELATIVE * 1.001}D) as bigint) end"""
    rows = rows.withColumn("cells", F.expr(f"transform(line, (c, i) -> if(isnan(try_cast(if(substring(kinds, i + 1, 1) = 'f', c, null) as double)), null, {cell}))"))
    counts = rows.select(*case, F.posexplode("cells").alias("pos", "cell")).filter("cell IS NOT NULL").groupBy(*case, "pos").agg(
        F.approx_count_distinct("cell").alias("n"))
    wide = counts.groupBy(*case).agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "pos")), asc=False), 1, 3).alias("wide"))
    rows = written(rows.join(wide, case, "left").withColumn(
        "cells", F.transform(F.coalesce("wide.pos", F.array().cast("array<int>")), lambda p: F.get("cells", p))).drop("wide").withColumn("node", _cell_node(case)))
    nodes = written(rows.select(*case, "range", "cells", "node").distinct())
    links = _with_neighbour_cells(nodes).select(F.col("node").alias("u"), _cell_node(case).alias("v")).filter("u <> v").join(
        nodes.select(F.col("node").alias("v")).distinct(), "v", "left_semi")
    return rows.join(components(links), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def _unmatched_large(rows: DataFrame, case: list) -> DataFrame:
    """Cases with a part whose ``rows`` have no matching, found by joins over all tasks.

    Equal lines are one node. Rows that agree at their position ``n`` of the order are matched to
    begin with, which is nearly all of them where noise has swapped a few.
    """
    group = [f"g{i}" for i in range(len(case) + 1)]
    wanted = ["side", "kinds", "line", "cells", "node", "n", "open"]
    rows = written(rows.select(
        *[F.col(c).alias(g) for c, g in zip([*case, "part"], group)], *wanted, F.md5(F.to_json(F.struct("part", "line"))).alias("id")))
    sides = {}
    for side, name in ((ACTUAL, "a"), (EXPECTED, "e")):
        mine = rows.filter(F.col("side") == side)
        nodes = mine.select(*group, "kinds", "cells", "node", F.col("id").alias(name), F.col("line").alias(f"{name}l")).dropDuplicates([*group, name])
        sides[name] = mine, written(nodes)
    (a_rows, a_nodes), (e_rows, e_nodes) = sides["a"], sides["e"]
    pairs = a_rows.filter("NOT open").select(*group, "n", F.col("id").alias("a")).join(
        e_rows.filter("NOT open").select(*group, "n", F.col("id").alias("e")), [*group, "n"])
    flow = pairs.groupBy(*group, "a", "e").agg(F.count(F.lit(1)).alias("n"))
    surplus = a_rows.filter("open").groupBy(*group, F.col("id").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    free = e_rows.filter("open").groupBy(*group, F.col("id").alias("e")).agg(F.count(F.lit(1)).alias("n"))

    def neighbours(front):
        here = front.join(a_nodes, [*group, "a"])
        near = _with_neighbour_cells(here.select(*group, "a", "root", "kinds", "al", "cells"))
        there = e_nodes.select(*group, "cells", "e", "el")
        return near.join(there, [*group, "cells"]).filter(_agree()).select(*group, "a", "e", "root")

    lost = unmatched_groups(group, flow, surplus, free, neighbours)
    return lost.select(*[F.col(g).alias(c) for g, c in zip(group, case)]).distinct()


def _unpaired(rows: DataFrame, keys: list) -> DataFrame:
    """(keys, attempt) whose ``rows`` (range, side, row_id, kinds, line, n, open) have no pairing within the tolerance.

    Exact: parts of one row a side are compared, larger ones with equal counts go through bipartite matching,
    those of up to ``PART_ROWS`` rows a side in one task each.
    """
    case = [*keys, "attempt"]
    rows = written(_with_part(rows, keys))
    a, e = F.col("side") == ACTUAL, F.col("side") == EXPECTED
    parts = written(rows.groupBy(*case, "part").agg(
        F.max("kinds").alias("kinds"), F.count_if(a).alias("n_a"), F.count_if(e).alias("n_e"),
        F.max(F.when(a, F.col("line"))).alias("al"), F.max(F.when(e, F.col("line"))).alias("el")))
    off = parts.filter((F.col("n_a") != F.col("n_e")) | ((F.col("n_a") == 1) & ~_agree())).select(*case).distinct()
    several = written(parts.filter("n_a = n_e AND n_a > 1").join(off, case, "left_anti").select(*case, "part", "n_a"))
    largest = several.filter(F.col("n_a") > PART_ROWS).drop("n_a")
    if not largest.isEmpty():
        off = off.union(written(_unmatched_large(rows.join(largest, [*case, "part"], "left_semi"), case)))
    larger = several.filter(F.col("n_a") <= PART_ROWS).drop("n_a").join(off, case, "left_anti")
    if larger.isEmpty():
        return off.distinct()
    rows = rows.drop("cells", "node", "n", "open")
    absolute, relative, expected = ABSOLUTE, RELATIVE, EXPECTED

    def match(frame):
        import numpy as np

        kinds = frame["kinds"].iloc[0]
        floats = [i for i, k in enumerate(kinds) if k == "f"]
        sides = []
        for wanted in (False, True):
            lines = frame.loc[(frame["side"] == expected) == wanted, "line"]
            texts = [tuple(line) for line in lines]
            exact = [(tuple(None if k == "f" else c for c, k in zip(t, kinds)), tuple(t[i] if t[i] in (None, "NaN") else "" for i in floats)) for t in texts]
            values = np.array([[np.nan if t[i] is None else float(t[i]) for i in floats] for t in texts])
            sides.append((exact, values))
        (a_exact, a), (e_exact, e) = sides
        number = {}
        a_class, e_class = (np.array([number.setdefault(x, len(number)) for x in exact]) for exact in (a_exact, e_exact))
        with np.errstate(invalid="ignore"):
            widest = max(range(len(floats)), key=lambda j: len(np.unique(e[:, j])))
            order = np.argsort(e[:, widest], kind="stable")  # nan last
            line = e[order, widest]
            reach = absolute + relative * (np.abs(a[:, widest]) * 1.001 + 2 * absolute)
            low, high = np.searchsorted(line, a[:, widest] - reach), np.searchsorted(line, a[:, widest] + reach, side="right")

            def partners(i):
                at = order[low[i]:high[i]] if np.isfinite(a[i, widest]) else order
                at = at[e_class[at] == a_class[i]]
                there, here = e[at], a[i]
                fits = (there == here) | (np.isnan(there) & np.isnan(here)) | (np.isfinite(there) & (np.abs(there - here) <= absolute + relative * np.abs(there)))
                return at[fits.all(axis=1)]

            of, held = np.full(len(e), -1), np.full(len(a), -1)
            for start in range(len(a)):  # a shortest augmenting path from each row
                came, queue, end = {}, [start], -1
                for i in queue:
                    for j in partners(i).tolist():
                        if j not in came:
                            came[j] = i
                            if of[j] < 0:
                                end = j
                                break
                            queue.append(int(of[j]))
                    if end >= 0:
                        break
                if end < 0:
                    return frame.iloc[:1][case]
                while end >= 0:
                    i = came[end]
                    of[end], held[i], end = i, end, int(held[i])
        return frame.iloc[:0][case]

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in case)
    return off.union(rows.join(larger, [*case, "part"], "left_semi").groupBy(*case, "part").applyInPandas(match, schema)).distinct()


def _tolerant_matches(rows: DataFrame, attempts: DataFrame, keys: list, faithful: bool, parts: int | None = None) -> DataFrame:
    """Attempts whose sorted rows agree pairwise, floats within the tolerance.

    ``attempts`` carries the expected ``kinds``. Rows sort by their columns in
    expected order; the default reading puts exact columns first, then the steps
    of the floats, then the floats, so that noise in one float cannot shift the
    rows against each other in another. Where a range of equal exact columns and steps
    does not agree in that order, a pairing of its rows is looked for.
    """
    tagged = _with_case(rows.drop("kinds"), attempts, keys, parts)
    projected = F.when(
        F.col("side") == ACTUAL, F.transform("mapping", lambda p: F.get("cells", p))
    ).otherwise(F.col("cells"))
    tagged = tagged.select(*keys, "attempt", "side", "row_id", "kinds", projected.alias("line"))
    sort_key = F.expr("""
        transform(line, (c, i) -> struct(
            case when substring(kinds, i + 1, 1) in ('i', 'd', 'f') then try_cast(c as double) end as num,
            case when substring(kinds, i + 1, 1) <> 'f' then c end as txt,
            substring(kinds, i + 1, 1) = 'f' as loose))""")
    tagged = tagged.withColumn("key", sort_key)
    several = F.length(F.regexp_replace("kinds", "[^f]", "")) > 1
    stepped = not faithful and not attempts.filter(several).isEmpty()
    if not faithful:
        plain = tagged.withColumn("steps", F.lit(None).cast("array<struct<pos: int, step: bigint>>"))
        tagged = _float_steps(tagged.filter(several), keys).unionByName(plain.filter(~several)) if stepped else plain
        steps = F.transform(F.coalesce("steps", F.array()), lambda s: F.struct(
            s["step"].cast("double").alias("num"), s["pos"].cast("string").alias("txt"), F.lit(True).alias("loose")))
        tagged = tagged.withColumn("key", F.concat(
            F.filter("key", lambda k: ~k["loose"]), steps, F.filter("key", lambda k: k["loose"]))).withColumn(
            "range", F.xxhash64(F.to_json(F.struct(F.filter("key", lambda k: ~k["loose"]), "steps")))).drop("steps")
    ranked = _numbered(tagged, [*keys, "attempt", "side"], [F.col("key").asc(), F.col("line").asc(), F.col("row_id").asc()], parts)
    if stepped and parts is not None:
        ranked = written(ranked)  # read again below; a number has to stay with its row
    if faithful:
        ranked = ranked.withColumn("range", F.lit(0).cast("long"))
    paired = ranked.groupBy(*keys, "attempt", "n").agg(
        F.max("kinds").alias("kinds"),
        *(F.max(F.when(F.col("side") == side, F.col(of))).alias(name)
          for side, of, name in ((ACTUAL, "line", "al"), (EXPECTED, "line", "el"), (ACTUAL, "range", "ar"), (EXPECTED, "range", "er"))))
    off = paired.filter(F.col("al").isNull() | F.col("el").isNull() | ~_agree())
    if not faithful:
        off = written(off.select(*keys, "attempt", "n", "kinds", "ar", "er"))
        # rows pair inside their range only, so one that meets another range leaves some row without a partner
        lost = off.filter("NOT (ar <=> er) OR kinds NOT LIKE '%f%f%'").select(*keys, "attempt").distinct()
        ranges = off.join(lost, [*keys, "attempt"], "left_anti").select(*keys, "attempt", F.col("ar").alias("range")).distinct()
        if not ranges.isEmpty():
            open_rows = ranked.join(ranges, [*keys, "attempt", "range"], "left_semi").join(
                off.select(*keys, "attempt", "n", F.lit(True).alias("open")), [*keys, "attempt", "n"], "left").select(
                *keys, "attempt", "range", "side", "row_id", "kinds", "line", "n", F.coalesce("open", F.lit(False)).alias("open"))
            lost = lost.union(_unpaired(written(open_rows), keys))
        off = lost
    return attempts.join(off.select(*keys, "attempt").distinct(), [*keys, "attempt"], "left_anti")


def _attempts(rows: DataFrame, cases: DataFrame, keys: list, faithful: bool, parts: int | None = None) -> DataFrame:
    """Column assignments to try per case.

    An attempt is ``loose`` where a column is equal within the tolerance only.
    """
    cands = F.zip_with("alike", "near", lambda x, y: F.concat(x, y))
    cases = cases.withColumn("kinds", F.array_join("e.kind", ""))
    facts = [*keys, "alike", "kinds"]
    if faithful:
        attempts = cases.select(*facts, F.lit(0).cast("long").alias("attempt"), F.transform(cands, F.array_min).alias("mapping")).filter(
            "size(array_distinct(mapping)) = size(mapping) and not exists(mapping, p -> p is null)")
    else:
        cases = cases.withColumn("cands", cands)
        flat = F.flatten("cands")
        sure = (F.size(flat) == F.size("e")) & (F.size(F.array_distinct(flat)) == F.size("e"))
        attempts = cases.filter(sure).select(*facts, F.lit(0).cast("long").alias("attempt"), flat.alias("mapping"))
        open_cases = cases.filter(~sure)
        if not open_cases.isEmpty():
            narrow = written(
                _refined(rows, open_cases, keys, parts).withColumn("cands", cands)
                .filter("forall(cands, c -> size(c) > 0)")
                .select(*facts, "cands", "near", "a_twin", "e_twin", "e_class"))
            # where all candidates of a column are twins any order is as good
            twins_only = F.expr("""
                forall(cands, c -> size(array_distinct(transform(c, p -> a_twin[p]))) = 1)
                and not exists(near, c -> size(c) > 0)""")
            in_turn = F.expr("""transform(cands, (c, i) ->
                get(c, size(filter(slice(e_class, 1, i), x -> x = e_class[i]))))""")
            turns = narrow.filter(twins_only).select(*facts, F.lit(0).cast("long").alias("attempt"), in_turn.alias("mapping")) \
                .filter("not exists(mapping, p -> p is null)")
            attempts = attempts.unionByName(turns)
            choice = narrow.filter(~twins_only)
            if not choice.isEmpty():
                attempts = attempts.unionByName(_assigned(rows.drop("kinds"), choice, keys, parts).join(choice.select(*facts), keys))
    loose = F.expr("exists(zip_with(mapping, alike, (p, c) -> array_contains(c, p)), hit -> not hit)")
    return attempts.withColumn("loose", loose).drop("alike")


def _settled(rows: DataFrame, attempts: DataFrame, keys: list, faithful: bool, exact: bool,
             floats: bool, parts: int | None = None) -> DataFrame:
    """Cases with an attempt under which the rows are equal."""
    def equal(tries):
        return (_exact_matches if exact else _hashed_matches)(rows, tries, keys, parts=parts).select(*keys).distinct()

    rows = rows.drop("kinds")
    if not floats:
        return equal(attempts)
    # rows that are equal agree in their order too, so where one column is a float one pass decides
    once = F.lit(parts is not None) & F.col("kinds").like("%f%") & ~F.col("kinds").like("%f%f%")
    sharp = attempts.filter("not loose").filter(~once)
    good = attempts.select(*keys).limit(0)
    if not sharp.isEmpty():
        good = written(equal(sharp))
    # equal columns may also pair up within the tolerance only
    rest = attempts.filter("kinds like '%f%'").join(good, keys, "left_anti")
    if not rest.isEmpty():
        good = good.unionByName(
            _tolerant_matches(rows, rest.drop("loose"), keys, faithful, parts).select(*keys).distinct())
    return good


def _agreeing(headers: DataFrame, rows: DataFrame, keys: list, faithful: bool, exact: bool, parts: int | None) -> DataFrame:
    """Cases whose sides are equal; ``parts`` as in ``_with_case``."""
    profiled = (headers, rows) if parts is None else (headers.repartition(parts, *keys), rows.repartition(parts, *keys))
    cases = written(
        _per_case(column_profile(*profiled, keys), keys)
        .filter("size(a) >= size(e) and forall(zip_with(alike, near, (c, d) -> size(c) + size(d)), k -> k > 0)"))
    if faithful and not cases.filter("exists(near, c -> size(c) > 0)").isEmpty():
        pairs = cases.select(*keys, F.posexplode("near").alias("e_pos", "n")).select(*keys, "e_pos", F.explode("n").alias("a_pos"))
        kept = _verified_pairs(rows, written(pairs), keys, parts).groupBy(*keys).agg(
            F.collect_list(F.struct("e_pos", "a_pos")).alias("kept"))
        cases = cases.join(kept, keys, "left").withColumn("near", F.transform("near", lambda c, i: F.filter(
            c, lambda p: F.coalesce(F.exists("kept", lambda k: (k["e_pos"] == i) & (k["a_pos"] == p)), F.lit(False))))).drop("kept")
    floats = not cases.filter("exists(e, x -> x.kind = 'f')").isEmpty()
    return _settled(rows, _attempts(rows, cases, keys, faithful, parts), keys, faithful, exact, floats, parts)


def compare_results(headers: DataFrame, rows: DataFrame, keys: list,
                    faithful=False, exact=True) -> DataFrame:
    """``keys..., passed`` for every case with a header on both sides.

    Extra actual columns are allowed, missing ones are not. ``exact=False``
    trusts 128-bit row fingerprints instead of grouping the rows themselves:
    no row of a large result is shuffled by content then. A case with a null key does
    not pass. ``rows`` is read several times
    and should be stored; the verdicts are written out.
    """
    keys = list(keys)
    both = headers.groupBy(*keys).agg(
        F.count_if(F.col("side") == ACTUAL).alias("n_a"), F.count_if(F.col("side") == EXPECTED).alias("n_e"),
    ).filter("n_a > 0 and n_e > 0").select(*keys)
    named = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    headers, rows = headers.filter(named), rows.filter(named)
    large = _large_cases(rows, keys)
    parts, n_large = _parts(rows, rows.count()), large.agg(F.sum("n")).first()[0]
    if n_large is None:
        good = _agreeing(headers, rows, keys, faithful, exact, parts)
    else:
        few = F.broadcast(large.select(*keys))
        usual, spread = ([df.join(few, keys, how) for df in (headers, rows)] for how in ("left_anti", "left_semi"))
        spread[1] = spread[1].repartition(_parts(rows, n_large), *keys, "row_id", "cells")  # a read task may have any number of rows
        good = _agreeing(*usual, keys, faithful, exact, parts).unionByName(_agreeing(*spread, keys, faithful, exact, None))
    verdicts = both.join(good.withColumn("passed", F.lit(True)), keys, "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return written(verdicts)


def frames_equal(actual: DataFrame, expected: DataFrame, faithful=False) -> bool:
    """Whether two frames hold the same result."""
    case = {"case": 0}
    headers = result_header(actual, case, ACTUAL).unionByName(result_header(expected, case, EXPECTED))
    rows = written(result_rows(with_unique_names(actual), case, ACTUAL).unionByName(
        result_rows(with_unique_names(expected), case, EXPECTED)))
    return compare_results(headers, rows, ["case"], faithful).first()["passed"]


def table_sets_match(actual, expected, strict: bool) -> Column:
    """Expected names all present; ``strict`` also allows no others."""
    a, e = F.array_distinct(actual), F.array_distinct(expected)
    covered = F.size(F.array_except(e, a)) == 0
    return covered & (F.size(F.array_except(a, e)) == 0) if strict else covered
