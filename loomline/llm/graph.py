"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of edges (a, b: long).

    Each round every node takes its least neighbour, pointers are followed twice, and the edges move to the roots, where
    those inside a root vanish. Every round at least halves the nodes that have edges. Lineage ends with each round.
    """
    edges = runtime.stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    mapping = None
    nodes = 2 * edges.count()  # at most
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = runtime.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "parents", nodes)
        for _ in range(2):  # each root is a node of the same edges
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            parent = runtime.stored(runtime.join_bounded(parent, up, ["root"], "inner").select("node", F.col("up").alias("root")), "parents", nodes)
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
        if mapping is None:
            mapping = parent
        else:
            mapping = runtime.stored(runtime.join_bounded(mapping, up, ["root"], "left").select("node", F.coalesce("up", "root").alias("root")), "roots", nodes)
        for side in ("a", "b"):
            edges = runtime.join_bounded(edges, parent.select(F.col("node").alias(side), F.col("root").alias(side + "_root")), [side], "inner").drop(side).withColumnRenamed(side + "_root", side)
        edges = runtime.stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges", nodes)
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
