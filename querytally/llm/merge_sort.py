"""Distributed merge sort of strings that knows common prefixes.

Tasks sort what they read into runs and front-code them: of every string only
the length of the prefix it shares with the one before and the rest go into the
exchange. A run is cut at sampled splitters, each receiving task merges its cuts
with a loser tree. A loser remembers how long a prefix it shares with the string
that beat it, so a comparison starts where two strings can first differ and no
known prefix is looked at again; the merged order comes with the common prefix
length of every two neighbours.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RUN = 50_000  # strings sorted at once
CHUNK = 2_000  # strings of a run that travel as one row
SAMPLES = 64  # per range
RANGE_BYTES = 32_000_000  # of strings that a task merges, about


def common_prefix(a: bytes, b: bytes, start=0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:
        middle = (start + end) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle
    return start


class LoserTree:
    """Merges runs of (prefix shared with the one before in the run, string, number)."""

    def __init__(self, runs):
        self._runs = [iter(r) for r in runs]
        size = 1
        while size < len(self._runs):
            size *= 2
        self._runs += [iter(())] * (size - len(self._runs))
        self._heads, self._known = [None] * size, [0] * size
        for r in range(size):
            self._advance(r)
        self._known = [0 if h is not None else -1 for h in self._heads]
        winners, self._losers = list(range(size)), [0] * size
        level = size
        while level > 1:
            beaten = [self._match(winners[i], winners[i + 1]) for i in range(0, level, 2)]
            for i, (won, lost) in enumerate(beaten):
                self._losers[level // 2 + i] = lost
            winners = [won for won, _ in beaten]
            level //= 2
        self._winner, self._size = winners[0], size

    def _advance(self, r):
        entry = next(self._runs[r], None)
        if entry is None:
            self._heads[r], self._known[r] = None, -1
        else:
            self._known[r], *self._heads[r] = entry

    def _match(self, a, b):
        """Winner and loser; both prefixes are shared with the same string, which neither precedes."""
        known = self._known
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        (x, i), (y, j) = self._heads[a], self._heads[b]
        same = common_prefix(x, y, known[a])
        won, lost = (a, b) if (x[same:same + 1], i, a) < (y[same:same + 1], j, b) else (b, a)
        known[lost] = same
        return won, lost

    def __iter__(self):
        """(prefix shared with the one before, string, number) in order."""
        while self._heads[self._winner] is not None:
            w = self._winner
            yield (self._known[w], *self._heads[w])
            self._advance(w)
            node = (w + self._size) // 2
            while node:
                w, self._losers[node] = self._match(w, self._losers[node])
                node //= 2
            self._winner = w


def _front_coded(run):
    """Rows of a sorted run: prefix lengths, lengths and bytes of the rests, numbers."""
    for i in range(0, len(run), CHUNK):
        part = run[i:i + CHUNK]
        shared = [0, *(common_prefix(a[0], b[0]) for a, b in zip(part, part[1:]))]
        rests = [s[n:] for n, (s, _) in zip(shared, part)]
        yield {
            "place": i, "shared": np.array(shared, "<u2").tobytes(), "sizes": np.array([len(r) for r in rests], "<u2").tobytes(),
            "rests": b"".join(rests), "numbers": np.array([n for _, n in part], "<i8").tobytes()}


def _decoded(chunks):
    """The strings of one run from its rows; a row's first string shares what it shares with the last of the row before."""
    before = b""
    for c in chunks:
        shared, sizes = np.frombuffer(c["shared"], "<u2").tolist(), np.frombuffer(c["sizes"], "<u2").tolist()
        at = 0
        for k, (n, size, number) in enumerate(zip(shared, sizes, np.frombuffer(c["numbers"], "<i8").tolist())):
            s = before[:n] + c["rests"][at:at + size]
            at += size
            yield (common_prefix(before, s) if k == 0 else n), s, number
            before = s


_ROW = pa.schema([
    ("range", pa.int32()), ("run", pa.int64()), ("place", pa.int64()), ("shared", pa.binary()), ("sizes", pa.binary()), ("rests", pa.binary()), ("numbers", pa.binary())])


def sorted_neighbours(strings: DataFrame) -> DataFrame:
    """number, reach for ``strings`` (value binary, number long), a written table.

    ``reach`` is the longest prefix that a string shares with any other: in
    sorted order, with one of its neighbours. The first and last string of a
    range do not see across its edge; there reach is the string's whole length, an upper
    bound. Ranges are as many as the strings' bytes ask for, one a task. Strings hold fewer than 65,536 bytes. Equal strings are ordered by
    number, so a value that holds most rows is still cut into ranges. Neither column
    may be null; an empty frame gives no rows.
    """
    spark = strings.sparkSession
    count, size = strings.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    share = min(1.0, ranges * SAMPLES / max(1, count))
    sample = strings.filter(F.pmod(F.xxhash64("number"), F.lit(1_000_000)) < int(share * 1_000_000)).select("value", "number").collect()
    sample = sorted((bytes(r.value), r.number) for r in sample)  # about SAMPLES strings a range
    splitters = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    def cut(batches):
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 32
        waiting = []

        def send():
            waiting.sort()
            edges = [0, *(bisect.bisect_left(waiting, s) for s in splitters), len(waiting)]
            rows = [
                {"range": r, "run": run, **row} for r, (a, b) in enumerate(zip(edges, edges[1:])) for row in _front_coded(waiting[a:b])]
            return pa.RecordBatch.from_pylist(rows, schema=_ROW)

        for batch in batches:
            for i in range(0, batch.num_rows, RUN):
                waiting += zip(batch.column(0).slice(i, RUN).to_pylist(), batch.column(1).slice(i, RUN).to_pylist())
                if len(waiting) >= RUN:
                    yield send()
                    waiting, run = [], run + 1
        if waiting:
            yield send()

    def merge(batches):
        runs, now = {}, None

        def merged():
            out, before = [], None
            for shared, s, number in LoserTree([_decoded(chunks) for chunks in runs.values()]):
                if before is not None:
                    out.append((before[1], max(before[2], shared)))
                    before = (s, number, shared)
                else:
                    before = (s, number, len(s))
                if len(out) >= 10_000:
                    yield out
                    out = []
            if before is not None:
                out.append((before[1], len(before[0])))
            yield out

        def rows():
            for out in merged():
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int32())], ["number", "reach"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != now:
                    if runs:
                        yield from rows()
                    runs, now = {}, row["range"]
                runs.setdefault(row["run"], []).append(row)
        if runs:
            yield from rows()

    coded = strings.select("value", "number").mapInArrow(cut, "range int, run long, place long, shared binary, sizes binary, rests binary, numbers binary")
    return coded.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "run", "place").mapInArrow(merge, "number long, reach int")
