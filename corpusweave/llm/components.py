"""Connected components by repeated contraction, on DataFrames.

Each round hooks every node to its smallest neighbour, jumps pointers twice and replaces the ends of every edge by their
labels; edges inside a label vanish and equal edges meet, so the graph shrinks by a factor each round. A component's
smallest node is its own label in every round, so the last label is the smallest node that can be reached. Every round is
written to the shared folder, so lineage stays short and a lost executor costs one stage. The driver learns one bit a
round: whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node and component for every node with an edge to another node."""
    current = c.staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.select(F.col("a").alias("node"), F.col("b").alias("to")).union(current.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hook = first = c.staged(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
        for _ in range(2):
            further = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = hook.join(further, "to").select("node", F.col("next").alias("to"))
        jumped = c.staged(hook, "hooks")
        c.unstage(first)
        hook = jumped
        maps.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("la"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("lb"))
        moved = current.join(left, "a").select("la", "b").distinct().join(right, "b").where("la <> lb")
        before, current = current, c.staged(moved.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), "edges")
        c.unstage(before)
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("to").alias("component"))
    for hook in maps[1:]:
        later = hook.select(F.col("node").alias("component"), F.col("to").alias("label"))
        out = out.join(later, "component", "left").select("node", F.coalesce("label", "component").alias("component"))
    if len(maps) == 1:
        return out
    out = c.staged(out, "components")
    c.unstage(current, *maps)
    return out
