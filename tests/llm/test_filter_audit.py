import random
import re
from itertools import permutations

import pytest

import __spark_entry__ as entry
from oracle import actual, actual_types, connect, expected, expected_types
from querytally.llm.filter_audit import audit, filter_audit, intervals, lehmer_rank

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ORDERS = ["".join(p) for p in permutations("ABCDE")]


def fails(text):
    words = WORD.findall(text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
    return out + ("D" if any(c in "#$%&*|" for c in text) else "")


def plain(docs, labels):
    """Every filter order applied to the documents, one by one."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    rows = []
    for key, text, lang in docs:
        copy = key is not None and key > first[text or ""]
        rows.append((lang or "", fails(text or "") + ("E" if copy else ""), key in good, key in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        lines = []
        for order in ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                removed_by[f] += len(gone)
                before = len([r for r in mine if f in r[1]]) - len(gone)
                left = [r for r in left if f not in r[1]]
                lines.append([part, order, step, len(left), len(gone), before, len([r for r in mine if r[1] == f]),
                              sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [tuple([*line, removed_by[line[1][line[2] - 1]]]) for line in lines]
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark):
    pick = random.Random(4)
    texts = [None, "", " \n", "word " * 250, "ABC", "#", "a\x0bb", "É" * 50, "Ab" * 300, "x" * 300_000, " "]
    texts += [" ".join(f"{'W' if i % 3 else 'w'}{j}" for j in range(150 + i * 10)) + ("|" if i % 4 == 0 else "") for i in range(12)]
    docs = [(pick.choice([i, i, i, None, 3]), pick.choice(texts), pick.choice(["en", "en", "de", "", None])) for i in range(400)]
    docs += [docs[5]] * 3
    labels = [(pick.choice([*range(400), None]), pick.choice([0, 1, None]), pick.choice([0, 1, None])) for _ in range(300)]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, n int, good int")
    return docs, labels, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_every_order_applied(made):
    docs, labels, frame, label_frame = made
    df = filter_audit(frame, label_frame)
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in df.collect()) == plain(docs, labels)


def test_empty_tables(made):
    docs, _, frame, labels = made
    assert filter_audit(frame.filter("false"), labels).count() == 0
    assert sorted(tuple(r) for r in filter_audit(frame, labels.filter("false")).collect()) == plain(docs, [])


def test_ranks_and_intervals():
    assert [lehmer_rank(p, "ABCDE") for p in ORDERS] == list(range(120))
    assert lehmer_rank("B", "ABCDE") == 24 and lehmer_rank("EA", "ABCDE") == 96
    covered = {}
    for mask, first, end, measure in intervals("ABCDE"):
        if measure.startswith("step_"):
            for rank in range(first, end):
                covered.setdefault((mask, rank), []).append(int(measure[5:]))
    for (mask, rank), steps in covered.items():
        assert steps == [1 + min(ORDERS[rank].index(f) for f in mask)]
    assert len(covered) == 31 * 120


def test_three_filters(spark):
    counts = spark.createDataFrame([("p", "", 5, 1, 0), ("p", "XZ", 4, 0, 2), ("p", "Y", 3, 1, 1)], "part string, mask string, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in audit(counts, "XYZ").collect()}
    assert len(rows) == 18
    r = rows["ZYX", 3]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) == (5, 0, 4, 0, 12)
    r = rows["YXZ", 1]
    assert (r.kept, r.removed, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (9, 3, 3, 1, 1, 18)


def test_query_against_sql(spark):
    directory = "/root/testdata/sf0.01"
    con, sql = connect(directory), entry.oracle_sql()["op11_filter_audit"]
    df = entry.queries()["op11_filter_audit"](spark, directory)
    assert actual(df) == expected(con, sql) and actual_types(df) == expected_types(con, sql)
