import random
import re

import pytest

from querytally.llm.components import components
from querytally.llm.near_duplicates import bands_for, first_of_each_group, near_duplicates
from querytally.llm.queries import op4

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    """Components by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i in sorted(sets):
        seen = set()
        for s in sets[i]:
            for j in holders.get(s, ()):
                if j not in seen:
                    seen.add(j)
                    common = len(sets[i] & sets[j])
                    if 100 * common >= percent * len(sets[i] | sets[j]):
                        a, b = sorted((root(i), root(j)))
                        parent[b] = a
            holders.setdefault(s, []).append(i)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def test_documents(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    got = sorted(map(tuple, op4(spark, SF).collect()))
    assert got == brute(rows, 3, 85)
    assert len({c for *_, c, _ in got}) < len(got)


def noisy(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_large_buckets_lose_no_link(spark):
    """Groups of copies around the threshold, a passage that many documents share, blocks of a few classes."""
    rng = random.Random(5)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        texts += [noisy(rng, base, rng.choice((0, 0, 1, 2, 3, 4, 5))) for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(60))
    for n in range(80):
        texts.append(passage + " " + " ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.choice((6, 8, 12, 20, 40)))))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (16, 512):
        assert sorted(map(tuple, near_duplicates(frame, shingle=3, percent=85, block=block).collect())) == brute(rows, 3, 85)


def test_odd_rows(spark):
    rows = [(9, "A b c d"), (4, "a B\tc  d"), (7, None), (8, ""), (6, " \n"), (3, "x"), (2, "X"), (1, "É x"), (5, "é x"), (11, "w " * 40_000), (10, "w " * 50_000)]
    extra = [(None, "a b c d"), (9, "a b c d")]
    frame = spark.createDataFrame([(*r, "k", 1, True) for r in rows + extra], "doc_id long, text string, key string, component long, kept boolean")
    got = near_duplicates(frame, shingle=3, percent=85).collect()
    want = brute(rows, 3, 85)
    assert sorted({tuple(r) for r in got if r.doc_id is not None}) == want
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 2, None, True)] and len(got) == len(rows) + 2
    kept = first_of_each_group(frame, shingle=3, percent=85)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, *_, k in want if k} | {None}
    assert near_duplicates(frame.filter("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(50)] + [(None, 3)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((i, root(i)) for i in parent)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands():
    assert bands_for(85) == (28, 6) and bands_for(80) == (33, 5)
    for percent in (80, 85):
        bands, rows = bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-5


def test_words_that_a_polynomial_confuses(spark):
    """The Thue-Morse word of two letters and its complement agree under any polynomial modulo 2**64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{word} {other} x", f"{other} {word} x", f"{word}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, shingle=3, percent=85).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]


def test_word_hashes_follow_the_words():
    import numpy as np

    from querytally.llm.grams import word_hashes, words

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \né") for _ in range(rng.randrange(60))).encode() for _ in range(300)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, edges = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    named = {}
    for s, e, h in zip(starts, ends, hashes):
        named.setdefault(bytes(data[s:e]), set()).add(int(h))
    assert all(len(h) == 1 for h in named.values()) and len({next(iter(h)) for h in named.values()}) == len(named) > 200
    assert len(word_hashes(data[:0], starts[:0], ends[:0])) == 0


def test_recall_of_pairs_at_the_threshold(spark):
    """Two thousand pairs with a similarity of 0.86: none is missed."""
    rng, rows = random.Random(6), []
    for pair in range(2000):
        base = [f"p{pair}w{i}" for i in range(400)]
        other = list(base)
        for at in rng.sample(range(2, 398, 4), 10):  # each edit changes three shingles of its own
            other[at] = f"e{rng.randrange(10**9)}"
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = near_duplicates(docs, shingle=3, percent=85).collect()
    assert {r.n_shingles for r in got} == {398} and all(r.component_id == r.doc_id // 2 * 2 for r in got)
