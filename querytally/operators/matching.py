"""Perfect matchings between two sides of any size, by augmenting paths as joins.

Rows of one content are one node with a capacity. A flow from left to right nodes
starts from pairs that are known to agree and grows in rounds: a breadth-first
search spreads from all left nodes with a surplus at once, every node takes one of the
nodes that reached it as its parent, and so the nodes fall into one tree a
root. Trees share no node, so one path of each tree to a right node with room is
augmented in the same round. Where the search reaches no room, no perfect
matching exists. Links are asked for where the search stands and never all made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..session import written


def _summed(*frames: DataFrame, by: list, of: str) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(*by).agg(F.sum(of).alias(of)).filter(F.col(of) > 0)


def _plus(frame: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if frame is None else frame.unionByName(more)


def _trees(group, flow, surplus, free, neighbours, turn):
    """Parents of all nodes that the search reaches, and the right nodes with room: (left, right, hits).

    left: a, root, via (the right node it came from); right: e, a, root. A group whose search has met room stops.
    """
    left = surplus.select(*group, "a", F.col("a").alias("root"), F.lit(None).cast("string").alias("via"))
    front, right, hits = left, None, None
    while True:
        found = neighbours(front.select(*group, "a", "root"))
        if right is not None:
            found = found.join(right.select(*group, "e"), [*group, "e"], "left_anti")
        # any parent will do; drawn at random, so that equal choices do not all fall on one root
        parent = F.min_by(F.struct("a", "root"), F.xxhash64("a", "e", F.lit(turn)))
        new = written(found.groupBy(*group, "e").agg(parent.alias("drawn")).select(*group, "e", "drawn.a", "drawn.root"))
        if new.isEmpty():
            break
        right = _plus(right, new)
        hits = _plus(hits, written(new.join(free.select(*group, "e"), [*group, "e"], "left_semi").select(*group, "e", "root")))
        back = flow.select(*group, "a", "e").join(new.select(*group, "e", "root"), [*group, "e"])
        back = back.join(hits.select(*group).distinct(), group, "left_anti").join(left.select(*group, "a"), [*group, "a"], "left_anti")
        front = written(back.groupBy(*group, "a").agg(F.min_by(F.struct("root", "e"), F.xxhash64("a", "e", F.lit(turn))).alias("drawn")).select(
            *group, "a", "drawn.root", F.col("drawn.e").alias("via")))
        if front.isEmpty():
            break
        left = left.unionByName(front)
    return left, right, hits


def _paths(group, left, right, hits):
    """Edges of one path a root from its end back: root, a, e, change (1 or -1)."""
    step = hits.groupBy(*group, "root").agg(F.min_by("e", F.xxhash64("e", "root")).alias("e"))
    ends, edges = step, None
    while True:
        came = written(step.join(right.select(*group, "e", "a"), [*group, "e"]))
        edges = _plus(edges, came.select(*group, "root", "a", "e", F.lit(1).cast("long").alias("change")))
        before = written(came.select(*group, "root", "a").join(left.select(*group, "a", "via"), [*group, "a"]).filter("via IS NOT NULL"))
        if before.isEmpty():
            return ends, edges
        edges = edges.unionByName(before.select(*group, "root", "a", F.col("via").alias("e"), F.lit(-1).cast("long").alias("change")))
        step = before.select(*group, "root", F.col("via").alias("e"))


def unmatched_groups(group: list, flow: DataFrame, surplus: DataFrame, free: DataFrame,
                     neighbours: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups without a perfect matching.

    ``flow`` (group, a, e, n) holds pairs that agree, ``surplus`` (group, a, n) and ``free``
    (group, e, n) what is left on either side, n in all three the number of rows; ids are strings.
    ``neighbours`` takes (group, a, root) and gives (group, a, e, root) for every right node that agrees with a.
    A group without surplus is matched; the frames may hold any number of groups. Group columns may
    not be named a, e, n, root, via, by, drawn or change.
    """
    surplus, free, flow = (written(x.filter("n > 0")) for x in (surplus, free, flow))
    lost, turn = None, 0
    while not surplus.isEmpty():
        turn += 1
        left, right, hits = _trees(group, flow, surplus, free, neighbours, turn)
        if hits is None or hits.isEmpty():
            return _plus(lost, surplus.select(*group)).distinct()
        alive = written(hits.select(*group).distinct())
        lost = _plus(lost, written(surplus.select(*group).distinct().join(alive, group, "left_anti")))
        surplus, free, flow = (x.join(alive, group, "left_semi") for x in (surplus, free, flow))

        ends, edges = _paths(group, left, right, hits)
        edges = written(edges)
        narrow = edges.filter("change < 0").join(flow, [*group, "a", "e"]).groupBy(*group, "root").agg(F.min("n").alias("least"))
        room = (
            ends.join(surplus.select(*group, F.col("a").alias("root"), F.col("n").alias("n_a")), [*group, "root"])
            .join(free.select(*group, "e", F.col("n").alias("n_e")), [*group, "e"]).join(narrow, [*group, "root"], "left"))
        moved = written(room.select(*group, "root", "e", F.least("n_a", "n_e", "least").alias("by")))
        changes = edges.join(moved.select(*group, "root", "by"), [*group, "root"]).select(*group, "a", "e", (F.col("change") * F.col("by")).alias("n"))
        flow = written(_summed(flow.select(*group, "a", "e", "n"), changes, by=[*group, "a", "e"], of="n"))
        taken = (-F.col("by")).alias("n")
        surplus = written(_summed(surplus.select(*group, "a", "n"), moved.select(*group, F.col("root").alias("a"), taken), by=[*group, "a"], of="n"))
        free = written(_summed(free.select(*group, "e", "n"), moved.select(*group, "e", taken), by=[*group, "e"], of="n"))
    return surplus.select(*group) if lost is None else lost.distinct()
