"""Components of undirected edges and trees of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import join_bounded, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges (a, b).

    Nodes take their least neighbour, pointers are doubled, edges move to the roots; at least half of the nodes with
    edges are gone after each round, and each round ends the lineage.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    roots = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
        twice = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        up = stored(join_bounded(up, twice, ["root"]).select("node", F.col("next").alias("root")))
        step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = up if roots is None else stored(join_bounded(roots, step, ["root"], "left").select("node", F.coalesce("next", "root").alias("root")))
        for side in ("a", "b"):
            edges = join_bounded(edges, up.select(F.col("node").alias(side), F.col("root").alias("_to")), [side]).drop(side).withColumnRenamed("_to", side)
        edges = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def review_groups(members: DataFrame, edges: DataFrame, group: str, node: str, prefix: str = "PG") -> DataFrame:
    """Each member with its proposed group: components within a group numbered by their least member; singletons have none.

    edges: (group, a, b). Nodes are told apart across groups by the group's own name.
    """
    def key(c: str):
        return F.struct(F.col(group).alias("g"), F.col(c).alias("n"))

    roots = components(edges.select(key("a").alias("a"), key("b").alias("b"))).select(F.col("node.g").alias(group), F.col("node.n").alias(node), F.col("root.n").alias("_root"))
    numbered = roots.select(group, "_root").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_root")))
    sized = roots.join(numbered, [group, "_root"]).withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(group, "_root")))
    named = sized.select(group, node, F.concat(F.lit(prefix), F.lpad(F.col("_k").cast("string"), 2, "0")).alias("proposed_group_id"), "group_size")
    return members.join(named, [group, node], "left").withColumn("is_singleton", F.col("proposed_group_id").isNull()).fillna(1, ["group_size"])


def leaves(tree: DataFrame, depth: int = 64) -> DataFrame:
    """parent, distance, leaf for merges (parent, left, right, distance): what each merge holds, followed down level by level."""
    down = tree.select("parent", "distance", F.explode(F.array("left", "right")).alias("child"))
    links = down.select(F.col("parent").alias("child"), F.col("child").alias("_below"))
    out, open_rows = None, down
    for _ in range(depth):
        met = stored(open_rows.join(links, "child", "left").select("parent", "distance", "child", "_below"))
        ended = met.where(F.col("_below").isNull()).select("parent", "distance", F.col("child").alias("leaf"))
        out = ended if out is None else out.unionByName(ended)
        open_rows = met.where(F.col("_below").isNotNull()).select("parent", "distance", F.col("_below").alias("child"))
        if not open_rows.take(1):
            return out
    raise ValueError("the merges do not form a tree")


def closest_ancestor(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """pairs (a, b) with the merge of least distance that holds both, and its distance."""
    left, right = (below.select("parent", "distance", F.col("leaf").alias(s)) for s in ("a", "b"))
    both = pairs.join(left, "a").join(right.drop("distance"), ["b", "parent"])
    near = both.groupBy("a", "b").agg(F.min(F.struct("distance", "parent")).alias("m"))
    return pairs.join(near.select("a", "b", F.col("m.parent").alias("ancestor"), F.col("m.distance").alias("ancestor_distance")), ["a", "b"], "left")


def branchlets(tree: DataFrame, below: DataFrame, group: str, share: float = 0.25) -> DataFrame:
    """Leaves joined by merges at or under the group's quantile of distances: group, node, root."""
    cut = tree.groupBy(group).agg(F.percentile("distance", share).alias("cut"))
    low = tree.join(cut, group).where(F.col("distance") <= F.col("cut")).select(group, "parent")
    held = below.join(low, "parent").select(group, "parent", "leaf")
    chain = held.withColumn("_before", F.lag("leaf").over(Window.partitionBy(group, "parent").orderBy("leaf"))).where(F.col("_before").isNotNull())
    key = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("n"))
    return components(chain.select(key("_before").alias("a"), key("leaf").alias("b"))).select(F.col("node.g").alias(group), F.col("node.n").alias("node"), F.col("root.n").alias("root"))
