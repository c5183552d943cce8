import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from querytally.llm.conversation_repair import (
    cheapest, damaged, repair_digests, repaired_conversations, search, ways_through)

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, gone string, copy int"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}  # by the last initial


def plain_damage(rows):
    """(conv, turn, role, text) after damage, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def all_repairs(rows):
    """Every (cost, audit, output) by a table over rows and last initials, ties by the audit; rows are (role, text, fault)."""
    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, out) in list(best.items()):
                new = "u" if last != "u" else "a"
                way = (cost + 5, audit + "I", out + [({"u": "user", "a": "assistant"}[new], "")])
                if new not in best or way[:2] < best[new][:2]:
                    best[new] = way
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def put(last, way):
            if last not in after or way[:2] < after[last][:2]:
                after[last] = way

        for last, (cost, audit, out) in best.items():
            put(last, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] and role[:1] in NEXT[last]:
                put(role[:1], (cost + more, audit + "K", out + [(role, text)]))
            for new, name in (("u", "user"), ("a", "assistant")):
                if new in NEXT[last]:
                    put(new, (cost + more + 1, audit + "R", out + [(name, text)]))
        best = inserted(after)
    return min((best[x] for x in ("", "a") if x in best), key=lambda w: w[:2])


def brute(rows):
    found = {}
    conversations = {r[0]: [] for r in rows}
    for row in plain_damage(rows):
        conversations[row[0]].append(row[1:])
    for conv, turns in conversations.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = [], []
        for _, role, text in turns:
            end = text.rstrip(SPACE)
            fault = "blank" if not end.strip(SPACE) else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.append((role, text))
            faults.append(fault)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        firsts = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit, out = all_repairs([(r, t, f) for (_, r, t), f in zip(turns, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def results(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r[0]: tuple(r[1:]) for r in rows}


def made(n, seed, lengths=(1, 2, 3, 5, 8, 12, 30)):
    pick = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(pick.choice(lengths)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "USER", None, "ua"])
            text = pick.choice(["Yes.", "No!", "half a", "", " \n", "é ü?", "x. \t\n", " ", None, f"text {turn}.", f"text {turn}. x?"])
            rows.append((conv, pick.choice([turn, turn, turn, turn // 2, None, turn + 3]), role, text))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "kept", i) for i, r in enumerate(rows)], SCHEMA)

    return make


def test_given_conversations(spark):
    for directory in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{directory}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        df = entry.queries()["op13_conversation_repair"](spark, directory)
        assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
        assert results(df) == brute(rows)


def test_odd_conversations(frame):
    rows = made(300, 1)
    assert results(repair_digests(damaged(frame(rows)))) == brute(rows)


def test_long_conversations_in_chunks(frame):
    """Chunks and a tree of tables give what one search gives, whatever their sizes."""
    rows = made(6, 2, (3, 40, 90)) + [(77, t, "user", "the same.") for t in range(60)]
    expected = brute(rows)
    assert results(repair_digests(damaged(frame(rows)))) == expected
    for sizes in ({"long": 10, "chunk": 7, "fan": 2}, {"long": 0, "chunk": 30, "fan": 8}):
        assert results(repair_digests(damaged(frame(rows)), **sizes)) == expected
        pieces = repaired_conversations(damaged(frame(rows)), **sizes).collect()
        texts = {}
        for r in sorted(pieces, key=lambda r: r.piece):
            texts.setdefault(r.conv_id, []).append(r.repaired)
        digests = {k: hashlib.sha256("\n".join(t for t in v if t).encode()).hexdigest() for k, v in texts.items()}
        assert digests == {k: v[-1] for k, v in expected.items()}
        heads = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in pieces if r.piece == 0}
        assert heads == {k: v[:-1] for k, v in expected.items()}


def test_conversation_that_is_gone(frame):
    rows = damaged(frame([(1, t, "user", "Hello.") for t in range(30)])).withColumn("gone", F.lit(True))
    for long in (1000, 3):
        assert results(repair_digests(rows, long=long)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(frame):
    empty = damaged(frame([]))
    assert repair_digests(empty).count() == 0 and repaired_conversations(empty).count() == 0


def test_search_against_all_edits():
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    pick = random.Random(3)
    for letters in ("xsuaoSUAO", "ua", "uuuuaaaS", "ssua"):
        for n in (0, 1, 2, 4, 7, 11, 24, 60):
            for _ in range(40):
                signs = "".join(pick.choice(letters) for _ in range(n))
                rows = [("user", "", "blank") if c == "x" else (roles[c.lower()], "t", "truncated" if c.isupper() else "") for c in signs]
                expected = all_repairs(rows)[:2]
                assert cheapest(signs) == expected and cheapest(signs, 5) == expected
                if n <= 24:
                    assert search(signs) == expected
    assert ways_through("")[0, 0] == (0, "", "0") and search("", 2, (1,)) is None
