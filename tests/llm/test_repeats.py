import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from querytally.llm.merge_sort import LoserTree, common_prefix, sorted_neighbours
from querytally.llm.queries import op9
from querytally.llm.repeats import cleaned_documents, merged_spans, without_repeats
from querytally.session import written

SF = "/root/testdata/sf0.01"


def brute_parts(rows, length):
    """(id, bytes, merged ranges, remaining parts) by counting every window of every text."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p:p + length] for _, r in raws for p in range(len(r) - length + 1))
    for i, r in raws:
        spans = merged_spans((p, p + length) for p in range(len(r) - length + 1) if seen[r[p:p + length]] > 1)
        edges = [0, *(x for s in spans for x in s), len(r)]
        yield i, len(r), spans, [r[a:b] for a, b in zip(edges[::2], edges[1::2])]


def brute(rows, length):
    out = [(i, n, sum(e - s for s, e in spans), len(spans), b"".join(parts)) for i, n, spans, parts in brute_parts(rows, length)]
    return sorted(out, key=lambda x: (x[0] is not None, x))


def test_documents(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 200)]
    assert sorted(map(tuple, op9(spark, SF).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    """Few letters, shared passages with differing ends, periodic stretches, short windows."""
    rng = random.Random(seed)
    letters = "abé" if seed else "ab"
    passages = ["".join(rng.choices(letters, k=rng.randrange(20, 90))) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages)[rng.randrange(8):rng.randrange(10, 90)] if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=rng.randrange(40))) for _ in range(rng.randrange(1, 5))]
        texts.append("".join(parts))
    texts += ["z" * 200, "xy" * 70, "xyz" * 30, None, "", "short"]
    rows = [*enumerate(texts), (None, texts[0]), (None, None), (3, texts[3]), (5, "another text of the same id" * 2)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kept string, n_bytes int").repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(frame, length=30, gram=9).collect()]
    assert sorted(got, key=lambda x: (x[0] is not None, x)) == brute(rows, 30)


def test_cleaned_rows_keep_their_columns(spark):
    passage = "é" * 3 + "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(1, "one " + passage + " end", "a"), (2, passage[1:] + "two", "b"), (3, None, "c"), (4, "alone", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __x string")
    got = cleaned_documents(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == [(1, "one é end", "a"), (2, "two", "b"), (3, None, "c"), (4, "alone", "d")]
    assert cleaned_documents(frame.filter("false")).count() == 0 and without_repeats(frame.filter("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), max_size=6))
def test_loser_tree_merges(runs):
    runs = [sorted((s, i * 100 + j) for j, s in enumerate(run)) for i, run in enumerate(runs)]

    def coded(run):
        return [(common_prefix(run[k - 1][0], s) if k else 0, s, n) for k, (s, n) in enumerate(run)]

    out = list(LoserTree([coded(r) for r in runs]))
    assert [(s, n) for _, s, n in out] == sorted(x for r in runs for x in r)
    assert [n for n, *_ in out] == [0, *(common_prefix(a[1], b[1]) for a, b in zip(out, out[1:]))][:len(out)]


def test_no_known_prefix_is_compared_again():
    """Merging long strings that differ at their ends only takes few byte comparisons."""
    import querytally.llm.merge_sort as m

    looked, plain = 0, m.common_prefix

    def counting(a, b, start=0):
        nonlocal looked
        found = plain(a, b, start)
        looked += found - start
        return found

    strings = [b"p" * 200 + i.to_bytes(2, "big") for i in range(1000)]
    runs = [[(201 if k else 0, s, k) for k, s in enumerate(strings[r::8])] for r in range(8)]
    runs = [[(plain(run[k - 1][1], s) if k else 0, s, n) for k, (_, s, n) in enumerate(run)] for run in runs]
    m.common_prefix = counting
    try:
        assert [s for _, s, _ in LoserTree(runs)] == strings
    finally:
        m.common_prefix = plain
    assert looked < 7 * 202 + 3 * 3 * len(strings)


def test_reach(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("ab", k=rng.randrange(1, 14))).encode(), i) for i in range(2000)] + [(b"same", 5000 + i) for i in range(3000)]
    got = dict(map(tuple, sorted_neighbours(written(spark.createDataFrame(rows, "value binary, number long").repartition(6))).collect()))
    ordered = sorted(rows)
    exact = {}
    for k, (s, n) in enumerate(ordered):
        exact[n] = max([common_prefix(s, ordered[j][0]) for j in (k - 1, k + 1) if 0 <= j < len(ordered)])
    assert set(got) == set(exact) and all(got[n] >= exact[n] for n in got)
    assert sum(got[n] != exact[n] for n in got) <= 2 * 8
