"""Connected components and verified links for the near-duplicate operators.

``components`` contracts a graph: each node points at its smallest neighbour,
pointers are followed to their roots, edges are rewritten to roots, until none
is left.  All steps are joins and aggregations with map-side combine; a node
with a third of all edges is one row of the pointer table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(edges.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), "edges")
    result = None
    while not edges.isEmpty():
        pointers = materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "pointers")
        while True:
            upper = pointers.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = pointers.join(upper, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            moved = materialize(moved, "pointers")
            pointers = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        result = pointers if result is None else materialize(_followed(result, pointers), "roots")
        edges = materialize(_rewritten(edges, pointers), "edges")
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = result.select(F.col("root").alias("node"), "root").distinct()
    return result.unionByName(roots)


def _followed(result: DataFrame, pointers: DataFrame) -> DataFrame:
    """Earlier pointers followed on, and nodes that point for the first time."""
    step = pointers.select(F.col("node").alias("root"), F.col("root").alias("above"))
    onward = result.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return onward.unionByName(pointers)


def _rewritten(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        step = pointers.select(F.col("node").alias(end), F.col("root").alias("to"))
        edges = edges.join(step, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
