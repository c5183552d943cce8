"""Exact copies by a tree merge of sorted digest runs.

Every partition of the input becomes a run: its digests in order, one entry a
digest with the best row met so far and the number of rows. The digest space is
cut into ranges, and within each range the runs of ``FAN`` neighbouring
partitions are exchanged and merged into one, round after round, until one run is
left (a binomial tree where FAN is 2). Every merge drops equal digests but
the entry of the row to keep, so a text that fills a third of the table is one entry
a run from the first round on and no task sees its rows.

A short hash orders the runs. Entries count as copies only after their SHA-256
digests and normalised lengths have been found equal, at every level.
"""

from __future__ import annotations

import heapq
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .names import free_name

SPACE = r"[\x20\x09-\x0D]+"
FAN = 8  # runs merged at once
RANGE_ROWS = 50_000  # about so many entries meet in the last merge of a range
TASK_ROWS = 200_000  # about so many entries a task of a round
_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit
# one entry of a run; smaller entries of one digest are better: more characters, then the
# smaller id (a null id last), then the earlier row
_ENTRY = np.dtype([
    ("hash", "<i8"), ("digest", "V32"), ("size", "<i8"), ("fewer", "<i8"), ("no_id", "<i8"), ("id", "<i8"), ("at", "<i8"), ("copies", "<i8")])
_PIECE = "slot int, run long, entries binary"


def members(docs: DataFrame, text="text", key="doc_id", at=None) -> DataFrame:
    """at, run, key, hash, digest, size, n_chars of every row, written in the order of each run.

    ``at`` numbers the rows (a column of ``docs`` may give it), ``run`` their partitions; the
    normalised text has no ASCII white space, ``size`` is its number of code points.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = F.monotonically_increasing_id() if at is None else F.col(at)
    rows = docs.select(place.alias("at"), F.col(key).cast("long").alias("key"), t.alias("t"), F.regexp_replace(t, SPACE, "").alias("n"))
    rows = rows.select(
        "at", "key", F.xxhash64("n").alias("hash"), F.unhex(F.sha2("n", 256)).alias("digest"),
        F.char_length("n").cast("long").alias("size"), F.char_length("t").cast("long").alias("n_chars"))
    rows = rows.withColumn("run", F.shiftright("at", _SHIFT))
    return written(rows.sortWithinPartitions("hash", "digest", "size"))


def _entries(rows):
    """Sorted entry tuples as the array that runs are exchanged in."""
    return np.array(rows, _ENTRY)


def _tuples(buffer):
    return np.frombuffer(buffer, _ENTRY).tolist()


def _best(entries):
    """Sorted entries with those of one verified text made one: the smallest, with all copies.

    Entries of one hash but other digests or sizes stay apart.
    """
    kept, copies = None, 0
    for entry in entries:
        if kept is not None and entry[:3] == kept[:3]:
            copies += entry[7]
            continue
        if kept is not None:
            yield (*kept[:7], copies)
        kept, copies = entry, entry[7]
    if kept is not None:
        yield (*kept[:7], copies)


def _slots(hashes, ranges):
    """Range numbers that grow with the hash."""
    return [(h + (1 << 63)) * ranges >> 64 for h in hashes]


def _pieces(run, entries, ranges):
    """A sorted run cut at the ranges' bounds: (slot, run, entries) rows."""
    keyed = groupby(zip(_slots([e[0] for e in entries], ranges), entries), key=lambda x: x[0])
    return [(slot, run, _entries([e for _, e in group]).tobytes()) for slot, group in keyed]


def _batch(rows):
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.binary())], ["slot", "run", "entries"])


def first_runs(rows: DataFrame, ranges: int) -> DataFrame:
    """Runs of the members' partitions, cut at the ranges: one row a run, range and batch."""
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("run", "hash", "digest", "size", "n_chars", "key", "at")]
            # the rows of a run come in order; a file read in parts gives several sorted runs of one number
            for number, group in groupby(zip(*columns), key=lambda x: x[0]):
                entries = [(h, d, s, -n, int(k is None), k or 0, at, 1) for _, h, d, s, n, k, at in group]
                yield _batch(_pieces(number, list(_best(sorted(entries))), ranges))

    return rows.select("run", "hash", "digest", "size", "n_chars", "key", "at").mapInArrow(run, _PIECE)


def merge_round(runs: DataFrame, left: int, ranges: int, tasks: int, fan=FAN) -> DataFrame:
    """Runs of ``fan`` neighbours exchanged and merged, range by range; ``left`` runs remain.

    A task gets whole (range, run) nodes, several small ones in early rounds, and
    holds one node at a time.
    """
    node = F.floor(F.col("run") / fan)
    place = F.floor((F.col("slot") * left + node) * tasks / (left * ranges)).cast("int")

    def merge(batches):
        def pieces():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("slot", "run", "entries")))

        for (slot, number), group in groupby(pieces(), key=lambda p: (p[0], p[1] // fan)):
            merged = list(_best(heapq.merge(*[_tuples(p[2]) for p in group])))
            yield _batch([(slot, number, _entries(merged).tobytes())])

    dealt = runs.repartitionById(tasks, F.least(place, F.lit(tasks - 1))).sortWithinPartitions("slot", "run")
    return dealt.mapInArrow(merge, _PIECE)


def winners(rows: DataFrame, fan=FAN, range_rows=RANGE_ROWS) -> DataFrame:
    """One row per text: hash, digest, size, keep_at, keep_id, group_size; ``rows`` as ``members`` gives them."""
    total, last = rows.agg(F.count(F.lit(1)), F.max("run")).first()
    ranges = max(1, -(-total // range_rows))
    # at least as many tasks as the session's shuffles have, where there are ranges for them
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs, left = first_runs(rows, ranges), (last or 0) + 1
    while True:
        left = -(-left // fan)
        tasks = max(1, min(max(usual, -(-total // TASK_ROWS)), left * ranges))
        runs = merge_round(runs, left, ranges, tasks, fan)
        if left == 1:
            break

    def spread(batches):
        for batch in batches:
            for buffer in batch.column("entries").to_pylist():
                e = np.frombuffer(buffer, _ENTRY)
                yield pa.RecordBatch.from_arrays([
                    pa.array(e["hash"]), pa.array(e["digest"].tolist(), pa.binary()), pa.array(e["size"]), pa.array(e["at"]),
                    pa.array(e["id"], mask=e["no_id"] == 1), pa.array(e["copies"])],
                    ["hash", "digest", "size", "keep_at", "keep_id", "group_size"])

    return runs.mapInArrow(spread, "hash long, digest binary, size long, keep_at long, keep_id long, group_size long")


def _placed(rows: DataFrame, fan, range_rows) -> DataFrame:
    """``rows`` with what is kept of their text.

    Winners go back first to the runs that hold their text, then within a run to
    its rows: a hot text is one row a run in the first join, and one partition's rows in the second.
    """
    same = ["hash", "digest", "size"]
    held = rows.select("run", *same).distinct().join(winners(rows, fan, range_rows), same)
    return rows.join(held, ["run", *same])


def exact_copies(docs: DataFrame, text="text", key="doc_id", fan=FAN, range_rows=RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without ASCII white space. Of equal texts
    the row with the most code points stays, then the smallest id (a null id comes
    last), then the earlier of repeated rows, so exactly one row of a group is kept. A null
    text is empty, and empty texts are one group; ids are whole numbers; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    placed = _placed(members(docs, text, key), fan, range_rows)
    return placed.select(
        F.col("key").alias(key), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def unique_documents(docs: DataFrame, text="text", key="doc_id", fan=FAN, range_rows=RANGE_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in ``exact_copies``."""
    at = free_name(docs, "row")
    numbered = written(docs.withColumn(at, F.monotonically_increasing_id()))
    stay = winners(members(numbered, text, key, at), fan, range_rows).select(F.col("keep_at").alias(at))
    return numbered.join(stay, at, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH t AS (SELECT doc_id, len(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER best AS r
    FROM t WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = 1 AS kept, sha256(t) AS text_sha256 FROM g"""
