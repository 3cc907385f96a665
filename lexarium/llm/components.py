"""Connected components of an undirected graph by contraction, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, small, written
from .exact_dedup import with_groups


def _led(rows: DataFrame, key: str, pointers: DataFrame, to: str) -> DataFrame:
    """rows with column `to`: where pointers (v, p) send `key`, null if nowhere. A node that many rows hold doesn't meet them in one task."""
    there = pointers.select(F.col("v").alias(key), F.col("p").alias(to))
    if small(there):
        return rows.join(F.broadcast(there), key, "left")
    held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    groups = written(there.join(held, key), "pointers")
    return with_groups(rows, groups, key, rows.count()).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b: long): component is the smallest node reached.

    Each round points every node of the contracted graph to its smallest neighbour, follows the pointers once more and
    contracts; the number of nodes at least halves. Loops and repeated edges do no harm; nodes without an edge aren't listed.
    """
    rest = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "parents")
        step = written(_led(parent, "p", parent, "pp").select("v", F.col("pp").alias("p")), "parents2")
        discard(parent)
        if labels is None:
            labels = step
        else:
            before, labels = labels, written(_led(labels, "p", step, "pp").select("v", F.coalesce("pp", "p").alias("p")), "labels")
            discard(before)
        moved = _led(_led(rest, "a", step, "pa"), "b", step, "pb").filter("pa <> pb")
        before, rest = rest, written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(before, *([step] if step is not labels else []))
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select(F.col("v").alias("node"), F.col("p").alias("component"))
