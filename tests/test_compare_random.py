"""Many small random cases in one pass, against the rules tried out directly."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querytally.operators.compare import compare_results

HEAD = "case int, side string, kinds string"
ROWS = "case int, side string, row_id long, kinds string, cells array<string>"
DOMAIN = {"i": [0, 1, None], "s": ["0", "x", None], "f": [1.0, 1.000000001, 2.0]}


def close(a, e):
    if isinstance(a, float) and isinstance(e, float):
        return abs(a - e) <= 1e-8 + 1e-5 * abs(e)
    return a == e


def rank(v):
    return (v is not None, 0 if v is None else v)


def kind(column, declared):
    return "n" if all(v is None for v in column) else declared


def column_equal(e, ek, a, ak):
    """Sorted values agree; the tolerance is around the actual value."""
    if kind(e, ek) != kind(a, ak) or len(e) != len(a):
        return False
    return all(close(x, y) for x, y in zip(sorted(e, key=rank), sorted(a, key=rank)))


def rows_equal(a_cols, e_cols):
    """Sorted rows agree one by one."""
    def ordered(cols):
        return sorted(zip(*cols), key=lambda r: [rank(v) for v in r])

    return all(all(close(x, y) for x, y in zip(p, q)) for p, q in zip(ordered(a_cols), ordered(e_cols)))


def rows_pair_up(a_cols, e_cols):
    """Some pairing of the rows agrees."""
    a, e = list(zip(*a_cols)), list(zip(*e_cols))
    return any(all(close(x, y) for p, q in zip(a, pick) for x, y in zip(p, q)) for pick in itertools.permutations(e))


def wanted(a, ak, e, ek):
    if len(a) < len(e):
        return False
    return any(
        all(column_equal(e[i], ek[i], a[p], ak[p]) for i, p in enumerate(pick))
        and rows_pair_up([a[p] for p in pick], e)
        for pick in itertools.permutations(range(len(a)), len(e)))


def wanted_faithful(a, ak, e, ek):
    if len(a) < len(e):
        return False
    taken = {}
    for i in range(len(e)):
        for p in range(len(a)):
            if column_equal(e[i], ek[i], a[p], ak[p]):
                taken[p] = i
                break
    back = {i: p for p, i in taken.items()}
    return len(back) == len(e) and rows_equal([a[back[i]] for i in range(len(e))], e)


def make_case(rnd):
    width, height = rnd.randint(1, 4), rnd.choice([0, 1, 2, 3, 4, 5])
    ek = "".join(rnd.choice("iisf") for _ in range(width))
    e = [[rnd.choice(DOMAIN[k]) for _ in range(height)] for k in ek]
    if width > 1 and rnd.random() < 0.3:
        e[1], ek = list(e[0]), ek[0] + ek[0] + ek[2:]
    pairs = [(list(col), k) for col, k in zip(e, ek)]
    rnd.shuffle(pairs)
    if rnd.random() < 0.3:
        k = rnd.choice("isf")
        pairs.insert(rnd.randint(0, len(pairs)), ([rnd.choice(DOMAIN[k]) for _ in range(height)], k))
    a, ak = [p[0] for p in pairs], "".join(p[1] for p in pairs)
    if height and rnd.random() < 0.5:  # disturb one column: other rows, or another value
        p = rnd.randrange(len(a))
        if rnd.random() < 0.6:
            rnd.shuffle(a[p])
        else:
            a[p][rnd.randrange(height)] = rnd.choice(DOMAIN[ak[p]])
    order = list(range(height))
    rnd.shuffle(order)
    return [[col[r] for r in order] for col in a], ak, e, ek


@pytest.fixture(scope="module")
def many(spark):
    rnd = random.Random(20)
    cases = [make_case(rnd) for _ in range(700)]
    heads, rows = [], []
    for n, (a, ak, e, ek) in enumerate(cases):
        for side, cols, kinds in (("actual", a, ak), ("expected", e, ek)):
            heads.append((n, side, kinds))
            for r, row in enumerate(zip(*cols)):
                rows.append((n, side, r, kinds, [None if v is None else str(v) for v in row]))
    return cases, spark.createDataFrame(heads, HEAD).coalesce(2).cache(), spark.createDataFrame(rows, ROWS).coalesce(2).cache()


@pytest.mark.parametrize("faithful", [False, True])
def test_random_cases(many, faithful):
    cases, headers, rows = many
    rule = wanted_faithful if faithful else wanted
    got = {r["case"]: r["passed"] for r in compare_results(headers, rows, ["case"], faithful).collect()}
    wrong = [(n, *c, got[n]) for n, c in enumerate(cases) if got[n] != rule(*c)]
    assert not wrong, (len(wrong), wrong[:3])
    assert 100 < sum(got.values()) < 600


def test_hashed_rows_agree(many):
    _, headers, rows = many
    exact, hashed = (
        Counter(map(tuple, compare_results(headers, rows, ["case"], exact=x).collect())) for x in (True, False))
    assert exact == hashed
    assert rows.filter(F.size("cells") == 0).count() == 0
