import hashlib
import random

import pytest

import __spark_entry__ as entry
from oracle import actual, actual_types, connect, expected, expected_types
from querytally.llm import exact_copies as module
from querytally.llm.exact_copies import _best, _entries, _tuples, exact_copies, unique_documents

SPACE = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string, at int, kept string, hash int"


def grouped(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        t = text or ""
        groups.setdefault("".join(c for c in t if c not in SPACE), []).append((-len(t), key is None, key or 0, i))
    return groups


def plain_in_order(rows):
    """Whether each row stays."""
    stay = {min(members)[3] for members in grouped(rows).values()}
    return [i in stay for i in range(len(rows))]


def plain(rows):
    """(id, keep, size, kept, digest) of every row, by dictionaries."""
    out = []
    for t, members in grouped(rows).items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(t.encode()).hexdigest()))
    return out


def found(df):
    return [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows, partitions):
        return spark.createDataFrame([(*r, i, "x", 1) for i, r in enumerate(rows)], SCHEMA).repartition(partitions, "at")

    return make


def rows_of(n, seed):
    pick = random.Random(seed)
    texts = ["", None, " \n\t", "a b", "ab", "a  b\n", "é", "é", " ", "x" * 200_000, "\x0b\x0c", "A B", "ab "]
    rows = [(pick.choice([i, i, i, None, 7]), pick.choice([*texts, f"t {i % 40}", f"t{i % 40} ", f"own {i}"])) for i in range(n)]
    return rows + [(500, "the hot one")] * 3 + [(1000 + i, "the  hot one") for i in range(n // 2)]


@pytest.mark.parametrize("partitions, fan, range_rows", [(1, 8, 50_000), (9, 2, 40), (23, 4, 7)])
def test_against_dictionaries(frame, partitions, fan, range_rows):
    rows = rows_of(300, partitions)
    df = exact_copies(frame(rows, partitions), fan=fan, range_rows=range_rows)
    assert ordered(found(df)) == ordered(plain(rows))


def test_unique_documents_keep_their_columns(frame):
    rows = rows_of(120, 5)
    df = frame(rows, 6)
    kept = unique_documents(df, range_rows=20)
    assert kept.columns == df.columns
    staying = [row for row, p in zip(rows, plain_in_order(rows)) if p]
    assert ordered([(r.doc_id, r.text) for r in kept.collect()]) == ordered(staying)


def test_empty_table(frame):
    empty = frame([], 1)
    assert exact_copies(empty).count() == 0 and unique_documents(empty).columns == empty.columns


def test_entries_of_one_hash_are_verified():
    """Equal short hashes join only with equal digests and lengths."""
    a, b = b"a" * 31 + b"\0", b"b" * 32
    rows = sorted([(5, a, 3, -3, 0, 1, 10, 1), (5, a, 3, -4, 0, 2, 11, 2), (5, b, 3, -9, 0, 0, 1, 1), (5, a, 4, -3, 0, 0, 2, 1), (6, a, 3, -3, 1, 0, 3, 1)])
    kept = list(_best(rows))
    assert [(e[1], e[2], e[6], e[7]) for e in kept] == [(a, 3, 11, 3), (a, 4, 2, 1), (b, 3, 1, 1), (a, 3, 3, 1)]
    assert _tuples(_entries(kept).tobytes()) == kept


def test_ranges_follow_the_hash():
    bounds = [-(1 << 63), -1, 0, (1 << 63) - 1]
    assert module._slots(bounds, 1) == [0] * 4
    assert module._slots(bounds, 4) == [0, 1, 2, 3]


def test_query_against_sql(spark):
    directory = "/root/testdata/sf0.01"
    con, sql = connect(directory), entry.oracle_sql()["op12_exact_copies"]
    df = entry.queries()["op12_exact_copies"](spark, directory)
    assert actual(df) == expected(con, sql) and actual_types(df) == expected_types(con, sql)
