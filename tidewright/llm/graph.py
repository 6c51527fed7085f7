"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut_lineage


def with_least(edges: DataFrame) -> DataFrame:
    """u, v, least: the smallest of u and its neighbours. Sums and a join, so a node with very many edges can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return edges.join(least, "u")


def is_settled(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then all components are stars around their smallest member."""
    of_u = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(0))
    return of_u.unionByName(roots).groupBy("u").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds")).filter("most > 1 OR kinds > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest member) for each node of ``edges`` (u, v); nodes without an edge are not there.

    Alternates two steps until every node points to one smallest member and to nothing else: each node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. Every round is written to the shared folder, as lineage would double in each. Ends after a number of rounds
    that grows with the logarithm of the graph's width.
    """
    current = cut_lineage(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not is_settled(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        linked = with_least(large)
        small = linked.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        own = linked.select("u", F.col("least").alias("v"))
        current = cut_lineage(small.unionByName(own).distinct(), "edges")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
