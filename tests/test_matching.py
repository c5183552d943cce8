"""Perfect matchings by joins, against augmenting paths in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from querytally.operators import compare
from querytally.operators.compare import compare_results, frames_equal
from querytally.operators.matching import unmatched_groups
from querytally.session import written


def perfect(left, right, links):
    """Whether capacities ``left`` and ``right`` can be used up along ``links``."""
    a = [i for i, n in left.items() for _ in range(n)]
    e = [j for j, n in right.items() for _ in range(n)]
    of = {}

    def augment(i, seen):
        for j in range(len(e)):
            if (a[i], e[j]) in links and j not in seen:
                seen.add(j)
                if j not in of or augment(of[j], seen):
                    of[j] = i
                    return True
        return False

    return len(a) == len(e) and all(augment(i, set()) for i in range(len(a)))


def test_random_graphs(spark):
    pick, graphs = random.Random(5), {}
    for g in range(120):
        n = pick.randrange(1, 8)
        left = {f"a{i}": pick.randrange(1, 4) for i in range(n)}
        right = {f"e{i}": 1 for i in range(pick.randrange(1, 8))}
        short = sum(left.values()) - sum(right.values())
        for _ in range(max(0, short)):
            right[pick.choice(list(right))] += 1
        for _ in range(max(0, -short)):
            left[pick.choice(list(left))] += 1
        links = {(a, e) for a in left for e in right if pick.random() < pick.choice([0.3, 0.6])}
        flow, room_a, room_e = {}, dict(left), dict(right)
        for a, e in pick.sample(sorted(links), len(links)):  # some pairs to begin with, not always good ones
            n = min(room_a[a], room_e[e], pick.choice([0, 1, 2]))
            if n:
                flow[a, e] = n
                room_a[a] -= n
                room_e[e] -= n
        graphs[g] = left, right, links, flow, room_a, room_e
    ids = "g int, p string"
    links = written(spark.createDataFrame([(g, "x", a, e) for g, (_, _, ls, *_) in graphs.items() for a, e in ls], f"{ids}, a string, e string"))
    flow = spark.createDataFrame([(g, "x", a, e, n) for g, (*_, f, _, _) in graphs.items() for (a, e), n in f.items()], f"{ids}, a string, e string, n long")
    surplus = spark.createDataFrame([(g, "x", a, n) for g, (*_, r, _) in graphs.items() for a, n in r.items()], f"{ids}, a string, n long")
    free = spark.createDataFrame([(g, "x", e, n) for g, (*_, r) in graphs.items() for e, n in r.items()], f"{ids}, e string, n long")
    lost = unmatched_groups(["g", "p"], flow, surplus, free, lambda front: front.join(links, ["g", "p", "a"]))
    expected = {g for g, (left, right, ls, *_) in graphs.items() if not perfect(left, right, ls)}
    assert {r.g for r in lost.collect()} == expected and 10 < len(expected) < 110
    none = unmatched_groups(["g", "p"], flow.limit(0), surplus.limit(0), free.limit(0), lambda front: front)
    assert none.count() == 0 and none.columns == ["g", "p"]


def close(a, e):
    return a == e or abs(a - e) <= 1e-8 + 1e-5 * abs(e)


@pytest.mark.parametrize("most", [1, 2000])
def test_dense_float_cases(spark, monkeypatch, most):
    """Rows that are near each other in two float columns, matched by joins and in tasks alike."""
    monkeypatch.setattr(compare, "PART_ROWS", most)
    pick, heads, rows, expected = random.Random(7), [], [], {}
    for case in range(40):
        # steps of 0.6 tolerances: a value agrees with its neighbours only
        e = [(100 + pick.randrange(7) * 6e-4, 50 + pick.randrange(7) * 3e-4) for _ in range(pick.randrange(2, 9))]
        a = [(x + pick.choice([-1, 0, 0, 1]) * 6e-4, y + pick.choice([-1, 0, 0, 1]) * 3e-4) for x, y in e]
        if case % 3 == 0:
            i = pick.randrange(len(a))
            a[i] = (a[i][0] + 1.2e-3, a[i][1])
        links = {(f"a{i}", f"e{j}") for i, p in enumerate(a) for j, q in enumerate(e) if close(p[0], q[0]) and close(p[1], q[1])}
        matched = perfect({f"a{i}": 1 for i in range(len(a))}, {f"e{j}": 1 for j in range(len(e))}, links)
        sorted_ok = all(close(x, y) for k in (0, 1) for x, y in zip(sorted(p[k] for p in a), sorted(q[k] for q in e)))
        expected[case] = matched and sorted_ok
        pick.shuffle(a)
        for side, lines in (("actual", a), ("expected", e)):
            heads.append((case, side, "ff"))
            rows += [(case, side, n, "ff", [repr(v) for v in line]) for n, line in enumerate(lines)]
    headers = spark.createDataFrame(heads, "case int, side string, kinds string")
    rows = spark.createDataFrame(rows, "case int, side string, row_id long, kinds string, cells array<string>")
    got = {r.case: r.passed for r in compare_results(headers, rows, ["case"]).collect()}
    assert got == expected and 5 < sum(expected.values()) < 38


def dense(spark, n, off=None):
    """n rows in one part: both columns grow by less than the tolerance, the second in another order."""
    base = spark.range(0, n, 1, 8).withColumn("m", F.col("id") * 7919 % n)
    x, y = (F.lit(1000.0) + F.col("id") * 4e-3), (F.lit(1000.0) + F.col("m") * 4e-3)
    shift = F.when(F.col("id") == (-1 if off is None else off), 0.05).otherwise(0.0)
    noise = (F.xxhash64("id") % 1000) * 2e-6  # swaps neighbours
    expected = base.select(x.alias("x"), y.alias("y"))
    return base.select((x + noise).alias("x"), (y + shift).alias("y")), expected


def test_one_dense_part_spreads(spark, monkeypatch):
    monkeypatch.setattr(compare, "PART_ROWS", 500)
    assert frames_equal(*dense(spark, 3000))
    assert not frames_equal(*dense(spark, 3000, off=1234))


def test_special_floats(spark):
    """Not-a-number agrees with itself only, and so does an infinity."""
    names = {"5.0": 5.0, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
    heads, rows, expected = [], [], {}
    for x in names:
        for y in names:
            for actual, wanted in (([(x, "1.0")], [(y, "1.0")]), ([("1.0", "2.0"), (x, "3.0")], [("1.0", "2.000000001"), (y, "3.0")])):
                case = len(expected)
                expected[case] = x == y
                for side, lines in (("actual", actual), ("expected", wanted)):
                    heads.append((case, side, "ff"))
                    rows += [(case, side, n, "ff", list(line)) for n, line in enumerate(lines)]
    headers = spark.createDataFrame(heads, "case int, side string, kinds string")
    rows = spark.createDataFrame(rows, "case int, side string, row_id long, kinds string, cells array<string>")
    for faithful in (False, True):
        assert {r.case: r.passed for r in compare_results(headers, rows, ["case"], faithful).collect()} == expected
