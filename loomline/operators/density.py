"""Density clusters of vectors within groups: a spanning tree of mutual reachability, its condensed tree, the stable clusters.

The tree grows in rounds: every component takes its cheapest edge to another one. Lists of nearest neighbours give that
edge as long as it is no dearer than what they leave out; only points whose lists can't tell are compared with their whole
group, by blocks. So the tree is that of all pairs, though few pairs are compared. Vectors never meet in a task but as
blocks; of a group, one task sees the tree's edges alone, 24 bytes a point.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import least_topic_size
from ..functions.vectors import unit
from ..storage import join_bounded, stored
from .graph import components
from .neighbours import block_join, nearest

#: Edges of one group's tree that a task may get; a larger group is refused, not cut.
TREE_EDGES = 50_000_000
#: Distances below count as this one, so that a density is never infinite.
LEAST_DISTANCE = 1e-6
#: Decimals of distances: equal ones merge at once, whatever the order of sums.
DIGITS = 9


def distance(similarity: Column) -> Column:
    """Of unit vectors, by their dot product."""
    return F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * similarity)), DIGITS)


def _reach(product: np.ndarray, a: dict, b: dict) -> np.ndarray:
    far = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * np.round(product, 12))), DIGITS)
    return np.maximum(np.maximum(far, a["core"][:, None]), b["core"][None, :])


def _cheapest(product: np.ndarray, a: dict, b: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row of a the cheapest edge to a row of b in another component."""
    cost = _reach(product, a, b)
    cost[a["component"][:, None] == b["component"][None, :]] = np.inf
    if not cost.size:
        return
    j = cost.argmin(1)
    i = np.flatnonzero(np.isfinite(cost[np.arange(len(cost)), j]))
    yield i, j[i], cost[i, j[i]]


def neighbour_graph(points: DataFrame, within: list[str], samples: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """points: within, node, vector (unit). samples: within, n, samples. Gives nodes with core and beyond, and edges with cost.

    core: the distance of the samples-th nearest other point, of the farthest in smaller groups. beyond: no point that
    isn't in the node's list is nearer; NULL if all are in it.
    """
    near = stored(nearest(points, within, "node", "vector", k).withColumn("far", distance(F.col("similarity"))))
    sized = join_bounded(near, samples, within)
    wanted = F.least("samples", F.col("n") - 1)
    facts = sized.groupBy(*within, "node").agg(F.max(F.when(F.col("rank") == wanted, F.col("far"))).alias("core"), F.max("far").alias("last"), F.max("rank").alias("seen"), F.first("n").alias("n"))
    cores = stored(facts.select(*within, "node", "core", F.when(F.col("seen") < F.col("n") - 1, F.greatest("last", "core")).alias("beyond")))
    other = cores.select(*within, F.col("node").alias("other"), F.col("core").alias("_core"))
    edges = near.join(cores.select(*within, "node", "core"), [*within, "node"]).join(other, [*within, "other"])
    return cores, stored(edges.select(*within, "node", "other", F.greatest("far", "core", "_core").alias("cost")))


def spanning_tree(points: DataFrame, within: list[str], samples: DataFrame, k: int) -> DataFrame:
    """within, a, b, cost: edges that connect each group at every bar as all its pairs do.

    Where several edges cost the same there can be more of them than a tree has; they change no component.
    """
    points = stored(points)
    cores, edges = neighbour_graph(points, within, samples, k)
    nodes = stored(cores.withColumn("component", F.col("node")))
    ends = lambda side, name: nodes.select(*within, F.col("node").alias(side), F.col("component").alias(name))
    tree = None
    while True:
        open_edges = stored(edges.join(ends("node", "_from"), [*within, "node"]).join(ends("other", "_to"), [*within, "other"]).where(F.col("_from") != F.col("_to")))
        edges = open_edges.drop("_from", "_to")  # the others are inside a component for good
        edge = F.struct("cost", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "_to")
        best = open_edges.groupBy(*within, F.col("_from").alias("component")).agg(F.min(edge).alias("edge"))
        bounds = nodes.groupBy(*within, "component").agg(F.min("beyond").alias("bound"), F.count(F.lit(1)).alias("size"))
        bounds = join_bounded(bounds, samples.select(*within, "n"), within).where(F.col("size") < F.col("n"))  # a group in one piece is done
        state = stored(bounds.join(best, [*within, "component"], "left"))
        if not state.take(1):
            break
        sure = F.col("edge").isNotNull() & (F.col("bound").isNull() | (F.col("edge.cost") <= F.col("bound")))
        picked = state.where(sure).select(*within, "component", "edge")
        unsure = state.where(~sure)
        if unsure.take(1):
            asked = nodes.join(unsure.select(*within, "component", F.col("edge.cost").alias("_cost")), [*within, "component"])
            asked = asked.where(F.col("_cost").isNull() | (F.col("beyond") < F.col("_cost"))).select(*within, "node", "core", "component")
            whole = nodes.select(*within, "node", "core", "component").join(points, [*within, "node"])
            found = block_join(asked.join(points, [*within, "node"]), whole, within, "node", "vector", _cheapest, ["core", "component"])
            found = found.select(*within, F.col("a").alias("node"), F.col("b").alias("other"), F.col("similarity").alias("cost"))
            found = stored(found.join(ends("node", "_from"), [*within, "node"]).join(ends("other", "_to"), [*within, "other"]))
            more = found.groupBy(*within, F.col("_from").alias("component")).agg(F.min(edge).alias("_edge"))
            merged = unsure.join(more, [*within, "component"], "left").select(*within, "component", F.least("edge", "_edge").alias("edge"))
            picked = picked.unionByName(merged)
        picked = stored(picked)
        new = picked.select(*within, "edge.a", "edge.b", "edge.cost")
        tree = stored(new if tree is None else tree.unionByName(new))
        name = lambda c: F.struct(*within, F.col(c).alias("node"))
        roots = components(picked.select(*within, "component", F.col("edge._to").alias("_to")).select(name("component").alias("a"), name("_to").alias("b")))
        roots = roots.select(*[F.col(f"node.{w}").alias(w) for w in within], F.col("node.node").alias("component"), F.col("root.node").alias("_root"))
        moved = nodes.join(roots, [*within, "component"], "left")
        nodes = stored(moved.select(*within, "node", "core", "beyond", F.coalesce("_root", "component").alias("component")))
    return nodes.select(*within, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("cost")).limit(0) if tree is None else tree.distinct()


def condensed_labels(edges: list[tuple[int, int, float]], n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each of n points, -1 for noise, and how firmly it is in it, from the edges of a spanning tree.

    Components that a bar leaves apart at one distance fall apart at once. A component with two parts of at least `least`
    points splits; with one, the others' points fall out of it; with none, it ends. The clusters with the most stability,
    the whole group apart, are taken, the larger first, then the one with the lowest point. Firmness is the density at
    which a point falls out, by that of the cluster's densest point.
    """
    parent = list(range(2 * n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size, density, parts = [1] * n, [0.0] * n, [()] * n
    edges = sorted(edges, key=lambda e: e[2])
    at = 0
    while at < len(edges):
        cost, end = edges[at][2], at
        links: dict[int, set[int]] = defaultdict(set)
        while end < len(edges) and edges[end][2] == cost:
            a, b = top(edges[end][0]), top(edges[end][1])
            if a != b:
                links[a].add(b)
                links[b].add(a)
            end += 1
        at = end
        while links:  # each piece that is connected at this distance becomes one node
            start = next(iter(links))
            piece, stack = {start}, [start]
            while stack:
                for other in links.pop(stack.pop(), ()):
                    if other not in piece:
                        piece.add(other)
                        stack.append(other)
            node = len(size)
            size.append(sum(size[p] for p in piece))
            density.append(1 / max(cost, LEAST_DISTANCE))
            parts.append(tuple(sorted(piece)))
            for p in piece:
                parent[p] = node
    labels, firm = np.full(n, -1), np.zeros(n)
    if len(size) == n or size[-1] != n:
        return labels, firm  # one point, or edges that don't span the group

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack.extend(parts[x])
        return out

    # Clusters in the order in which they split off: where they begin, what falls out of them, the clusters below.
    born, stability, below, fallen = [0.0], [0.0], [[]], [[]]
    work = [(len(size) - 1, 0)]
    while work:
        node, cluster = work.pop()
        while True:
            level = density[node]
            large = [p for p in parts[node] if size[p] >= least]
            for p in parts[node]:
                if size[p] < least or len(large) > 1:
                    stability[cluster] += size[p] * (level - born[cluster])
                if size[p] < least:
                    fallen[cluster].extend((x, level) for x in points(p))
            if len(large) != 1:
                break
            node = large[0]
        for p in large:
            below[cluster].append(len(born))
            work.append((p, len(born)))
            born.append(level)
            stability.append(0.0)
            below.append([])
            fallen.append([])
    taken = [False] * len(born)
    worth = stability[:]
    for c in range(len(born) - 1, 0, -1):
        inner = sum(worth[d] for d in below[c])
        taken[c] = not below[c] or stability[c] >= inner
        worth[c] = max(stability[c], inner)
    chosen = []
    work = list(below[0])
    while work:
        c = work.pop()
        if not taken[c]:
            work.extend(below[c])
            continue
        held, inside = [], [c]
        while inside:
            d = inside.pop()
            held.extend(fallen[d])
            inside.extend(below[d])
        chosen.append(held)
    for label, held in enumerate(sorted(chosen, key=lambda h: (-len(h), min(x for x, _ in h)))):
        most = max(level for _, level in held)
        for x, level in held:
            labels[x], firm[x] = label, level / most
    return labels, firm


def density_clusters(rows: DataFrame, within: list[str], key: str, vector: str, min_size: int | None = None, k: int = 64) -> DataFrame:
    """within, key, micro_topic_id (-1: noise; 0 is the group's largest) and micro_topic_probability.

    min_size: least points of a cluster, and which nearest point a point's core reaches; by default a fiftieth of the
    group, between 5 and 50. k: length of the lists of neighbours, which changes no result. Rows with a NULL group, key
    or vector are left out; keys must be unique within a group. A group too small for two clusters is noise.
    """
    points = rows.select(*within, F.col(key).alias("node"), unit(F.col(vector)).alias("vector")).where(F.col("node").isNotNull() & F.col(vector).isNotNull())
    points = stored(points.dropna(subset=within))
    size = F.lit(min_size) if min_size else least_topic_size(F.count(F.lit(1)))
    samples = stored(points.groupBy(*within).agg(F.count(F.lit(1)).alias("n"), size.cast("int").alias("samples")))
    most = samples.agg(F.max("n"), F.max("samples")).first()
    if most[0] is not None and most[0] > TREE_EDGES:
        raise ValueError(f"a group has {most[0]} points; its tree is condensed in one task, which takes {TREE_EDGES}")
    tree = spanning_tree(points, within, samples, max(k, (most[1] or 0) + 1))
    # A loop at every point, so that the task sees those without an edge too.
    loops = points.select(*within, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("cost"))
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*(f"`{w}` {types[w]}" for w in within), f"`{key}` {types['node']}", "micro_topic_id long, micro_topic_probability double"])
    edges = join_bounded(tree.unionByName(loops), samples, within)

    def label(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(np.concatenate([table[c].to_numpy() for c in ("a", "b")]), return_inverse=True)
        a, b = at[: len(table)], at[len(table) :]
        real = a != b
        labels, firm = condensed_labels(list(zip(a[real].tolist(), b[real].tolist(), table["cost"].to_numpy()[real].tolist(), strict=True)), len(nodes), table["samples"][0].as_py())
        groups = [pa.repeat(table[w][0], len(nodes)) for w in within]
        columns = [*groups, pa.array(nodes.tolist(), table["a"].type), pa.array(labels, pa.int64()), pa.array(np.round(firm, 6))]
        return pa.Table.from_arrays(columns, [*within, key, "micro_topic_id", "micro_topic_probability"])

    return edges.groupBy(*within).applyInArrow(label, schema)
