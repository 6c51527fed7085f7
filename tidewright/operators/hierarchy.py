"""Parent-child trees and reachability over an edge table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut_lineage


def descend(nodes: DataFrame, key: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """Depth and root of every node; roots are the nodes without a parent.

    Nodes that no root reaches are left out: ``rooted`` reports them. Goes on until a level is empty. A tree deeper than ``max_depth``, if given, is an error, never a shorter result.
    One join per level instead of a recursive CTE: the CTE stops at a fixed number of rows
    (a million by default) and keeps its levels in executor memory.
    """
    tree = nodes.select(F.col(key).alias("_id"), F.col(parent).alias("_up"))
    edges = tree.filter(F.col("_up").isNotNull())
    roots = tree.filter(F.col("_up").isNull()).select("_id", F.col("_id").alias("root"), F.lit(0).alias("depth"))
    level = cut_lineage(roots, "level")
    found = level
    for depth in count(1):
        above = level.select(F.col("_id").alias("_up"), "root", "depth")
        below = edges.join(above, "_up").select("_id", "root", (F.col("depth") + 1).alias("depth"))
        level = cut_lineage(below, "level")
        if level.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"the tree is deeper than {max_depth}")
        found = found.unionByName(level)
    return found.withColumnRenamed("_id", key)


def rooted(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Root and depth of every node, whatever the depth: ``(key, root, depth, problem)``, one row per node.

    Pointer doubling: a node knows the ancestor ``2**r`` steps above it after round ``r``, so a chain of a million nodes takes twenty joins. A node whose way up ends at a
    parent that is not in the table has ``problem`` = ``missing parent``, one whose way never ends ``cycle``; both have a null root and depth. Only nodes still on their way are joined, and
    each round is written to shared storage. Keys must be unique and not null.
    """
    tree = nodes.select(F.col(key).alias("_id"), F.col(parent).alias("_up"))
    known = tree.select(F.col("_id").alias("_up"), F.lit(True).alias("_there"))
    # at: the ancestor reached; steps: how far above; done: root, missing or null while on the way.
    start = tree.join(known, "_up", "left").select(
        "_id",
        F.when(F.col("_up").isNull(), F.col("_id")).otherwise(F.col("_up")).alias("_at"),
        F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long").alias("_steps"),
        F.when(F.col("_up").isNull(), "root").when(F.col("_there").isNull(), "missing").alias("_done"),
    )
    state = cut_lineage(start, "pointers")
    # After as many doublings as there are binary digits in the number of nodes, only nodes below a cycle are on their way.
    for _ in range(state.count().bit_length()):
        moving = state.filter(F.col("_done").isNull())
        if moving.isEmpty():
            break
        above = state.select(F.col("_id").alias("_at"), F.col("_at").alias("_next"), F.col("_steps").alias("_more"), F.col("_done").alias("_end"))
        moved = moving.drop("_done").join(above, "_at").select("_id", F.col("_next").alias("_at"), (F.col("_steps") + F.col("_more")).alias("_steps"), F.col("_end").alias("_done"))
        state = cut_lineage(state.filter(F.col("_done").isNotNull()).unionByName(moved), "pointers")
    at_root = F.col("_done") == "root"
    problem = F.when(F.col("_done") == "missing", "missing parent").when(F.col("_done").isNull(), "cycle")
    return state.select(F.col("_id").alias(key), F.when(at_root, F.col("_at")).alias("root"), F.when(at_root, F.col("_steps")).alias("depth"), problem.alias("problem"))


def reach(edges: DataFrame, start: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Fewest steps from any start node to every node that can be reached.

    Goes on until nothing new is reached; if that takes more than ``max_steps``, when given, it is an error.
    ``edges(src, dst)``, ``start(node)``. One join per step; the frontier is written to shared
    storage each time, so the plan stays short and a lost executor costs one step at most.
    """
    edges = edges.select("src", "dst").distinct()
    frontier = cut_lineage(start.select("node").distinct().withColumn("step", F.lit(0)), "frontier")
    seen = frontier
    for step in count(1):
        next_nodes = (
            frontier.join(edges, frontier["node"] == edges["src"])
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(seen.select("node"), "node", "left_anti")
            .withColumn("step", F.lit(step))
        )
        frontier = cut_lineage(next_nodes, "frontier")
        if frontier.isEmpty():
            break
        if max_steps is not None and step > max_steps:
            raise ValueError(f"some nodes are more than {max_steps} steps away")
        seen = seen.unionByName(frontier)
    return seen
