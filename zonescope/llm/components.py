"""Connected components of an edge table, labelled with their smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonescope.plans.workspace import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b), by contraction.

    Each round every node points at the smallest of itself and its neighbours, and the graph is
    contracted along the pointers, until no edge is left; a star takes one round, a chain a number
    of rounds logarithmic in its length. Minima are aggregated before they are shuffled, and joined
    from written tables, so that Spark can split the join of a node with very many edges.
    """
    edges = written(edges.select("a", "b").filter("a != b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("to")), "pointers")
        rounds.append(pointers)
        one = written(edges.join(pointers, edges["a"] == pointers["node"]).select(
            F.col("to").alias("a"), "b"), "half-edges")
        edges = written(one.join(pointers, one["b"] == pointers["node"]).select(
            "a", F.col("to").alias("b")).filter("a != b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].select("node", F.col("to").alias("component"))
    for pointers in rounds[1:]:
        step = pointers.select(F.col("node").alias("at"), "to")
        found = written(found.join(step, F.col("component") == F.col("at"), "left").select(
            "node", F.coalesce("to", "component").alias("component")), "labels")
    return found
