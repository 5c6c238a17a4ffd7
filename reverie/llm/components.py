"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, lookup, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root), root the same for every node of a component; nodes without an edge are absent.

    Each round points every node at its least neighbour, shortens the pointers by one join, and replaces the ends of the
    edges by what they point at, so that the edge table shrinks until it is empty. Minima are combined before the shuffle,
    and a hub or a giant component is met by lookup, which gives no task all rows of a key. Every table is written to the shared
    folder, so lineage stays short and a lost executor costs a re-read; a round deletes the tables of the one before.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots = None
    while roots is None or left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")), "cc-first")
        n = first.count()
        above = first.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = materialise(lookup(first, above, "up", "inner", n).select("node", F.col("top").alias("up")), "cc-step")
        if roots is None:
            found, on = None, step.select("node", F.col("up").alias("root"))
        else:
            found, on = roots, step.select(F.col("node").alias("root"), "up")
            on = lookup(roots, on, "root", "left", n).select("node", F.coalesce("up", "root").alias("root"))
        roots = materialise(on, "cc-roots")
        a, b = (step.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        half = lookup(left, a, "a", "inner", n)
        moved = lookup(half if n <= BROADCAST_ROWS else materialise(half, "cc-half"), b, "b", "inner", n).where("a_up <> b_up")
        now = materialise(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "cc-edges")
        discard(left, first, step, found)
        left = now
    return roots
