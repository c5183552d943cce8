"""Repair of conversation structure by depth-first branch and bound.

A conversation is in order if its roles read ``(s?(ua)+)?`` by their initials. Rows may
be kept, given another role or deleted, and empty turns may be inserted, at a
cost each; the cheapest edits are searched on an explicit stack. A node is a
row and what must follow there; a prefix of edits that reaches it at a higher cost,
or at the same cost with a later audit, is cut by the node's dominance table, and one
that cannot end better than the incumbent (cost, audit) is cut by a lower
bound on the rest. An empty stack proves the incumbent optimal.

Conversations of up to ``SPAN`` rows are searched whole. In longer ones every span is searched
between every two states, and the tables of neighbours are merged, which gives the same
edits. Up to ``LONG`` rows that happens in one task's row group; beyond, however long a
conversation is, its chunks are rows of their own and their tables meet in a tree.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.numbering import number_within
from ..session import written
from .grams import worker_cache

SPACE = " \t\n\v\f\r"
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5  # costs; CUT_OFF is added for a truncated row that stays
SPAN = 24  # rows searched at once; the worst ones take a few milliseconds
LONG = 1000  # rows of a conversation that is repaired as one group
CHUNK = 240  # rows of a chunk of a longer one
MERGED = 32  # chunk tables merged at once
BROADCAST_IDS = 100_000
KNOWN_SEARCHES = 200_000  # kept by a worker; the dictionary starts anew beyond

# what a conversation may go on with, by state: at the beginning, after the system turn, after a user's, after an assistant's
_AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_ROLES = {"u": "user", "a": "assistant"}
_DUE = {state: next(x for x in after if x != "s") for state, after in _AFTER.items()}
COMPLETE = (0, 3)


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults planted by crc32 of ``conv_id:turn`` modulo 20; a column ``gone`` marks rows to drop.

    0 drops the row, 1 empties the text, 2 removes its ``.``, ``!`` and ``?``, 3 doubles the row, 4 makes it
    a user's. A null role or text, and a null in the hashed name, is one space.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _sign(role, text, seen_before):
    """(sign, fault) of a row: its initial, a capital where the text is cut off, ``x`` where it has to go."""
    body = text.strip(SPACE)
    if not body:
        return "x", "blank"
    if seen_before:
        return "x", "duplicate"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (initial, "") if body[-1] in ".!?" else (initial.upper(), "truncated")


def _bounds(signs):
    """Least cost of the rows from each place on, whatever comes before.

    A row costs its cheapest edit, and of two neighbours that may not follow each other one has to
    be edited or something inserted between; neighbours are charged once.
    """
    own = {"x": DELETE, "s": 0, "u": 0, "a": 0, "o": REROLE}
    cost = [own.get(c, DELETE) for c in signs]  # a truncated row is cheapest deleted
    least = [0] * (len(signs) + 2)
    for i in range(len(signs) - 1, -1, -1):
        least[i] = least[i + 1] + cost[i]
        if signs[i:i + 2] in ("ss", "us", "as", "uu", "aa", "sa"):
            least[i] = max(least[i], least[i + 2] + 1)
    return least


def search(signs, entry=0, exits=COMPLETE):
    """Cheapest (cost, audit) that leads from state ``entry`` over all rows to one of ``exits``; None if there is none.

    ``signs`` has a letter for each row. The audit has a letter for each edit in order (D, I, K, R);
    of several cheapest ones it is the first in ASCII order. Two audits of one cost that
    reach the same node are never one the beginning of the other, so the smaller stays smaller whatever follows.
    """
    n, least, best = len(signs), _bounds(signs), None
    reached = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if reached[i, state] != (cost, audit):
            continue  # dominated since it was put here
        if i == n and state in exits and (best is None or (cost, audit) < best):
            best = cost, audit
        steps = [(i, _AFTER[state][_DUE[state]], cost + INSERT, audit + "I")]
        if i < n:
            sign = signs[i]
            steps.append((i + 1, state, cost + DELETE, audit + "D"))
            if sign != "x":
                stays = cost + (CUT_OFF if sign.isupper() else 0)
                steps.append((i + 1, _AFTER[state][_DUE[state]], stays + REROLE, audit + "R"))
                if sign.lower() in _AFTER[state]:
                    steps.append((i + 1, _AFTER[state][sign.lower()], stays, audit + "K"))
        steps.sort(key=lambda s: (s[2] + least[s[0]], s[3]), reverse=True)  # the most promising is taken first
        for step in steps:
            at, to, spent, edits = step
            if best is not None:
                bound = spent + least[at]
                if bound > best[0] or bound == best[0] and edits > best[1][:len(edits)]:
                    continue
            if (at, to) in reached and reached[at, to] <= (spent, edits):
                continue
            reached[at, to] = spent, edits
            stack.append(step)
    return best


def known_search(signs, entry=0, exits=COMPLETE):
    """``search``, or what it found for the same signs before: short conversations recur."""
    known = worker_cache("conversation repairs", dict)
    if len(known) > KNOWN_SEARCHES:
        known.clear()
    asked = signs, entry, exits
    if asked not in known:
        known[asked] = search(signs, entry, exits)
    return known[asked]


def ways_through(signs, span=SPAN):
    """The cheapest way from every state to every other over all rows, ``via`` the last one."""
    whole = None
    for at in range(0, max(1, len(signs)), span):
        found = [(e, x, known_search(signs[at:at + span], e, (x,))) for e in _AFTER for x in _AFTER]
        ways = {(e, x): (*w, "") for e, x, w in found if w}
        whole = ways if whole is None else merged_ways(whole, ways)
    return {(e, x): (cost, audit, str(x)) for (e, x), (cost, audit, _) in whole.items()}


def merged_ways(left, right):
    """Ways over two neighbouring parts: {(entry, exit): (cost, audit, via)}."""
    best = {}
    for (entry, middle), a in left.items():
        for (begin, end), b in right.items():
            if middle == begin:
                way = tuple(x + y for x, y in zip(a, b))
                best[entry, end] = min(best.get((entry, end), way), way)
    return best


def cheapest(signs, span=SPAN):
    """(cost, audit) over a whole conversation."""
    if len(signs) <= span:
        return known_search(signs)
    ways = ways_through(signs, span)
    return min(ways[0, x][:2] for x in COMPLETE if (0, x) in ways)


def apply_edits(rows, audit, state=0):
    """``rows`` of (role, text) after the edits of ``audit``."""
    rows, out = iter(rows), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        letter = role[:1] if edit == "K" else _DUE[state]
        out.append((role if edit == "K" else _ROLES[letter], text))
        state = _AFTER[state][letter]
    return out


def rendered(rows):
    return "\n".join(f"{role}:{text}" for role, text in rows)


def _illegal(initials):
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _repair_whole(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired text of (turn, role, text) rows in order."""
    seen, signs, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in rows:
        sign, fault = _sign(role, text, (role, text) in seen)
        seen.add((role, text))
        signs.append(sign)
        faults[fault] += 1
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cheapest("".join(signs))
    text = rendered(apply_edits([r[1:] for r in rows], audit))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], _illegal([r[1][:1] for r in rows]), cost, audit, text


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _batches(rows, schema, size=500):
    """Rows (tuples) as record batches of bounded length."""
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def _mapped(df: DataFrame, names, make, fields) -> DataFrame:
    """Rows that ``make`` yields from a partition's rows, read in order; ``fields`` are a DDL string after conv_id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([df.schema["conv_id"]] + list(StructType.fromDDL(fields)))
    arrow = to_arrow_schema(schema)
    return df.select(*names).mapInArrow(lambda batches: _batches(make(_rows(batches, names)), arrow), schema)


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_COUNT_FIELDS = ", ".join(f"{c} long" for c in _COUNTS)
_RESULT_FIELDS = f"gaps long, {_COUNT_FIELDS}, cost long, audit string, repaired string"
_RESULTS = ("gaps", *_COUNTS, "cost", "audit")


def _order():
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def _same(left, right):
    """Join condition on conv_id, a null id included."""
    return left["conv_id"].eqNullSafe(right["conv_id"])


def _short(rows: DataFrame) -> DataFrame:
    """One row per conversation, each searched whole."""
    def run(rows):
        for conv, group in groupby(rows, key=lambda r: r[0]):
            yield (conv, *_repair_whole([r[1:4] for r in group if not r[4]]))

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return _mapped(dealt, ["conv_id", "turn", "role", "text", "gone"], run, _RESULT_FIELDS)


# tables of long conversations -------------------------------------------------------------------

_TABLE_FIELDS = (
    f"part long, {_COUNT_FIELDS}, first string, last string, "
    "ways array<struct<entry:int, exit:int, cost:long, audit:string, via:string>>")
_TABLE = ["conv_id", "part", *_COUNTS, "first", "last", "ways"]


def _numbered(rows: DataFrame, chunk) -> DataFrame:
    """Rows that are not gone with their place ``pos``, chunk and whether role and text came before."""
    live = rows.filter(~F.col("gone")).select("conv_id", "turn", "role", "text")
    live = number_within(live, ["conv_id"], _order(), name="pos", start=0)
    live = live.withColumn("same", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = live.groupBy("conv_id", "same").agg(F.min("pos").alias("f_pos")).withColumnRenamed("conv_id", "f_id")
    joined = live.join(first, F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("pos") == F.col("f_pos")), "left")
    return written(joined.select(
        "conv_id", F.floor(F.col("pos") / chunk).alias("part"), "pos", "turn", "role", "text", F.col("f_pos").isNull().alias("seen")))


def _chunk_tables(numbered: DataFrame) -> DataFrame:
    def run(rows):
        for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
            signs, counts, initials = "", dict.fromkeys(_COUNTS, 0), []
            for _, _, _, role, text, seen in group:
                sign, fault = _sign(role, text, seen)
                signs += sign
                initials.append(role[:1])
                if fault:
                    counts[fault] += 1
            counts["illegal"] = _illegal(initials)
            yield (conv, part, *(counts[c] for c in _COUNTS), initials[0], initials[-1], _listed(ways_through(signs)))

    dealt = numbered.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return _mapped(dealt, ["conv_id", "part", "pos", "role", "text", "seen"], run, _TABLE_FIELDS)


def _listed(ways):
    return [{"entry": e, "exit": x, "cost": c, "audit": t, "via": v} for (e, x), (c, t, v) in ways.items()]


def _ways(listed):
    return {(w["entry"], w["exit"]): (w["cost"], w["audit"], w["via"]) for w in listed}


def merge_tables(left, right):
    """The table of two neighbouring parts: counts, end initials and the cheapest way between every two states."""
    counts = [a + b for a, b in zip(left[:4], right[:4])]
    counts[3] += _illegal([left[5], right[4]])
    return (*counts, left[4], right[5], merged_ways(left[6], right[6]))


def _merged(tables: DataFrame, fan) -> DataFrame:
    def run(rows):
        for (conv, part), group in groupby(rows, key=lambda r: (r[0], r[1] // fan)):
            whole = None
            for row in group:
                table = (*row[2:8], _ways(row[8]))
                whole = table if whole is None else merge_tables(whole, table)
            yield (conv, part, *whole[:6], _listed(whole[6]))

    dealt = tables.repartition(F.col("conv_id"), F.floor(F.col("part") / fan)).sortWithinPartitions("conv_id", "part")
    return _mapped(dealt, _TABLE, run, _TABLE_FIELDS)


def _long(rows: DataFrame, ids: DataFrame, most: int, chunk=CHUNK, fan=MERGED):
    """(summary, pieces) of the conversations in ``ids``, none with more than ``most`` rows.

    The summary has one row per conversation, pieces hold the repaired text chunk by chunk.
    """
    numbered = _numbered(rows, chunk)
    chunks = written(_chunk_tables(numbered))
    tables, parts = chunks, -(-most // chunk)
    while parts > 1:
        tables, parts = _merged(tables, fan), -(-parts // fan)
    ends = F.filter("ways", lambda w: (w["entry"] == 0) & w["exit"].isin(*COMPLETE))
    best = F.array_min(F.transform(ends, lambda w: F.struct(w["cost"], w["audit"], w["via"])))
    whole = written(tables.select("conv_id", *_COUNTS, best.alias("best")))

    turns = numbered.filter("turn IS NOT NULL").groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    of = whole.select(F.col("conv_id").alias("w_id"), *_COUNTS, "best")
    turns = turns.select(F.col("conv_id").alias("t_id"), "gaps")
    summary = (
        ids.join(of, ids["conv_id"].eqNullSafe(of["w_id"]), "left").join(turns, ids["conv_id"].eqNullSafe(turns["t_id"]), "left")
        .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS)],
                F.coalesce("best.cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit")))

    steps = whole.select(F.col("conv_id").alias("s_id"), "best.via", F.posexplode(F.split("best.via", "")).alias("s_part", "to"))
    steps = steps.filter("to <> ''").select(
        "s_id", F.col("s_part").cast("long").alias("s_part"), F.col("to").cast("int").alias("to"),
        F.when(F.col("s_part") == 0, 0).otherwise(F.substring(F.col("via"), F.col("s_part"), F.lit(1)).cast("int")).alias("begin"))
    taken = chunks.join(steps, F.col("conv_id").eqNullSafe(F.col("s_id")) & (F.col("part") == F.col("s_part"))).select(
        "s_id", "s_part", "begin", F.expr("filter(ways, w -> w.entry = begin AND w.exit = to)[0].audit").alias("edits"))

    def render(rows):
        for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
            group = list(group)
            yield conv, part, rendered(apply_edits([r[3:5] for r in group], group[0][6], group[0][5]))

    edited = numbered.join(taken, F.col("conv_id").eqNullSafe(F.col("s_id")) & (F.col("part") == F.col("s_part")))
    dealt = edited.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    pieces = _mapped(dealt, ["conv_id", "part", "pos", "role", "text", "begin", "edits"], render, "piece long, repaired string")
    return summary, pieces


def _streamed_digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of a conversation's pieces joined by line feeds, one at a time: the digest is sequential by definition."""
    def run(rows):
        for conv, group in groupby(rows, key=lambda r: r[0]):
            digest, begun = hashlib.sha256(), False
            for _, _, text in group:
                if text:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
            yield conv, digest.hexdigest()

    dealt = pieces.filter("repaired <> ''").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return _mapped(dealt, ["conv_id", "piece", "repaired"], run, "repaired_sha256 string")


def _parted(rows: DataFrame, long):
    """(rows of short conversations, rows of long ones or None, ids of the long ones, rows of the longest)."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > long)
    ids = written(sizes)
    most, n = ids.agg(F.max("size"), F.count(F.lit(1))).first()
    if not n:
        return rows, None, ids, 0
    ids = ids.select("conv_id")
    side = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return rows.join(side, _same(rows, ids), "left_anti"), rows.join(side, _same(rows, ids), "left_semi"), ids, most


def repaired_conversations(rows: DataFrame, long=LONG, chunk=CHUNK, fan=MERGED) -> DataFrame:
    """Repaired conversations in pieces: conv_id, piece, repaired, and on piece 0 the counts, cost and audit.

    ``rows`` has conv_id, turn, role, text and gone (true: not there, its conversation is). Rows go by turn, null
    turns first, then by role and text, so ties and repeated rows are in a defined order; a null conv_id is a
    conversation of its own; role and text are not null. A conversation without
    rows has zeros, an empty audit and an empty text. An empty table gives no rows. Conversations of more
    than ``long`` rows have a piece for each ``chunk`` rows.
    """
    few, many, ids, most = _parted(rows, long)
    columns = ["conv_id", F.col("piece"), "repaired", *_RESULTS]
    out = _short(few).withColumn("piece", F.lit(0).cast("long")).select(*columns)
    if many is None:
        return out
    summary, pieces = _long(many, ids, most, chunk, fan)
    heads = summary.withColumnRenamed("conv_id", "h_id").withColumn("h_piece", F.lit(0).cast("long"))
    at = pieces["conv_id"].eqNullSafe(heads["h_id"]) & (pieces["piece"] == heads["h_piece"])
    rest = heads.join(pieces, at, "full").select(
        F.coalesce("conv_id", "h_id").alias("conv_id"), F.coalesce("piece", "h_piece").alias("piece"),
        F.coalesce("repaired", F.lit("")).alias("repaired"), *_RESULTS)
    return out.unionByName(rest)


def repair_digests(rows: DataFrame, long=LONG, chunk=CHUNK, fan=MERGED) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Cases as in ``repaired_conversations``.
    """
    few, many, ids, most = _parted(rows, long)
    out = _short(few).select("conv_id", *_RESULTS, F.sha2("repaired", 256).alias("repaired_sha256"))
    if many is None:
        return out
    summary, pieces = _long(many, ids, most, chunk, fan)
    digests = _streamed_digests(pieces).withColumnRenamed("conv_id", "d_id")
    rest = summary.join(digests, summary["conv_id"].eqNullSafe(digests["d_id"]), "left")
    return out.unionByName(rest.select(
        "conv_id", *_RESULTS, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
