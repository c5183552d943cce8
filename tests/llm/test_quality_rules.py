import math
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from oracle import actual, actual_types, connect, expected, expected_types
from querytally.llm.quality_rules import RULES, Rule, good_documents, quality_verdicts, thresholds

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "one two", "a b c a b c", "a b c a b c a b c\na b c", "ab c a bc", "x\nx\n\ny\nx\n \n \n",
    "# <a|b> 100% &*$", "É Ñ ß ABC déf", "\x0b\x0cword joined here", "w " * 30_000, " ".join(f"w{i}" for i in range(60)), "a a a a a",
]


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 2 else "en", i, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "en", 1, "y"), (5, "a b c a b c", "de", 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, stratum string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(13, 1, 0), (13, 1, 1), (None, 1, 0), (5, None, 0), (14, 0, 0)], "doc_id long, quality int, toxic int")


def test_counts_of_odd_texts(odd, labels):
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in quality_verdicts(odd, labels).collect())
    assert got == sorted((i, *base(t)) for i, t in [*enumerate(TEXTS), (-1, "null id"), (5, "a b c a b c")])
    kept = good_documents(odd, labels)
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [(13, TEXTS[13], None, 13, "x")]


def test_null_and_empty_strata_differ(spark):
    """Each has its own cutoffs, and a text counts once however many copies are labelled."""
    clean = " ".join(f"w{i}" for i in range(80))
    lined = "\n".join([*(" ".join(f"l{i}w{j}" for j in range(20)) for i in range(6)), *["again"] * 5])
    rows = [(i, f"{clean} {i}", None) for i in range(400)] + [(1000 + i, f"n{i} {lined}", "") for i in range(400)]
    rows += [(2000 + i, clean, "copies") for i in range(400)] + [(9000, lined, None), (9001, lined, ""), (9002, lined, "copies")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i < 9000], "doc_id long, quality int")
    rules = (Rule("lines", "n_dup_lines", "n_lines", (900, 300)),)
    kept = {r.doc_id: r.kept for r in quality_verdicts(docs, labels, rules=rules).collect()}
    assert (kept[9000], kept[9001], kept[9002]) == (False, True, True)
    assert {r.doc_id for r in good_documents(docs, labels, rules=rules).collect()} == {i for i, k in kept.items() if k}


def test_certified_cutoffs_against_sql(spark):
    """Over one stratum the labels suffice: the row's cutoffs reject documents that pass the base rules."""
    directory = "/root/testdata/sf0.01"
    con, name = connect(directory), "quality_rules_one_stratum"
    df = entry.queries()[name](spark, directory)
    assert actual(df) == expected(con, entry.oracle_sql()[name]) and actual_types(df) == expected_types(con, entry.oracle_sql()[name])
    assert df.filter("NOT kept AND NOT base_failed").count() > 0


def test_empty_tables(odd, labels):
    assert quality_verdicts(odd.filter("false"), labels).count() == 0
    assert {r.doc_id for r in quality_verdicts(odd, labels.filter("false")).filter("kept").collect()} == {13}


def bound(x, n, level):
    """Upper Clopper-Pearson bound by bisection on exact binomial sums."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
        low, high = (p, high) if tail > level else (low, p)
    return high


def test_cutoffs_follow_the_exact_bound(spark):
    rule = Rule("symbols", "n_symbols", "n_words", (500, 200, 100))
    rows = []
    for stratum, n, over in (("a", 400, (0, 3, 30)), ("b", 40, (0, 0, 0)), ("c", 900, (0, 4, 9))):
        for i in range(n):
            share = 600 if i < over[0] else 300 if i < over[1] else 150 if i < over[2] else 0
            rows.append((len(rows), stratum, False, share, 1000))
    counts = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, n_symbols long, n_words long")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    got = {r.stratum: r.cut_symbols for r in thresholds(counts, labels, (rule,), risk=0.03, error=0.06).collect()}
    want = {}
    for stratum, n, over in (("a", 400, (0, 3, 30)), ("b", 40, (0, 0, 0)), ("c", 900, (0, 4, 9))):
        want[stratum] = None
        for c, x in zip(rule.cutoffs, over):
            if bound(x, n, 0.06 / 3) > 0.03:
                break
            want[stratum] = c
    assert got == want and want == {"a": 200, "b": None, "c": 100}


def test_false_rejections_stay_rare(spark):
    """On the held rows themselves every stratum loses fewer good documents than the risk allows."""
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    v = quality_verdicts(d, labels, risk=0.2).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed")
    for r in v.selectExpr("stratum", "CAST(kept AS int) AS k").groupBy("stratum").avg("k").collect():
        assert r["avg(k)"] > 0.8
    assert len(RULES) == 4


def test_against_sql(spark):
    name = "op10_quality_rules"
    df, con, sql = entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]
    assert actual(df) == expected(con, sql) and actual_types(df) == expected_types(con, sql)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
