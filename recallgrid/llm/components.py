"""Connected components of an edge table by repeated contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: root is the least node of the component.

    Each round hooks every vertex to its least neighbour, follows that pointer twice, and replaces
    the edges by those between what is left; vertices of one component collapse towards its least
    one. Minima are partially aggregated before each shuffle and every join reads written tables on
    both sides, so adaptive execution can split a vertex with many edges.
    """
    members = None
    edges = scratch.table(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.table(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "hook")
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            nxt = scratch.table(hook.join(up, "p").select("a", F.col("pp").alias("p")), "jump")
            scratch.drop(hook)
            hook = nxt
        if members is None:
            members = hook.select(F.col("a").alias("node"), F.col("p").alias("root"))
            old = None
        else:
            moved = hook.select(F.col("a").alias("root"), F.col("p").alias("to"))
            old = members
            members = scratch.table(
                members.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "members"
            )
        a = hook.select("a", F.col("p").alias("pa"))
        b = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        nxt = scratch.table(
            edges.join(a, "a")
            .join(b, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        scratch.drop(edges, *([old, hook] if old is not None else []))
        edges = nxt
    if members is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members
