"""Blocked similarity joins and density clusters against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import density, neighbours


def table(spark, groups, dims=5, seed=1, clumps=4, spread=0.15):
    """Unit vectors around a few centers, with some far from all and exact copies."""
    draw = random.Random(seed)
    rows, key = [], 0
    for group, n in groups.items():
        centers = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(clumps)]
        for _ in range(n):
            kind = draw.random()
            if kind < 0.1 and rows and rows[-1][0] == group:
                v = rows[-1][2]
            elif kind < 0.25:
                v = [draw.gauss(0, 1) for _ in range(dims)]
            else:
                v = [c + draw.gauss(0, spread) for c in draw.choice(centers)]
            norm = math.sqrt(sum(x * x for x in v))
            rows.append((group, key, [x / norm for x in v]))
            key += 1
    return rows, spark.createDataFrame(rows, "g string, id long, v array<double>")


def sims(rows, group):
    ids = [r[1] for r in rows if r[0] == group]
    m = np.array([r[2] for r in rows if r[0] == group])
    return ids, m @ m.T


@pytest.mark.parametrize("values", [1 << 17, 64 * 5])
def test_blocks_find_every_pair_once(spark, values):
    rows, df = table(spark, {"x": 150, "y": 40, "z": 1})
    cell = neighbours.keep_pairs(None, 0.8, False)
    got = neighbours.block_join(df, None, ["g"], "id", "v", cell, [], values).collect()
    want = set()
    for g in "xyz":
        ids, s = sims(rows, g)
        want |= {(g, ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if s[i, j] >= 0.8}
    assert len(got) == len({(r.g, r.a, r.b) for r in got}) and {(r.g, r.a, r.b) for r in got} == want and len(want) > 500


def test_nearest_equals_brute_force(spark):
    rows, df = table(spark, {"x": 200, "y": 7})
    got = {(r.g, r.node, r.rank): (r.other, round(r.similarity, 9)) for r in neighbours.nearest(df, ["g"], "id", "v", 10).collect()}
    want = {}
    for g in "xy":
        ids, s = sims(rows, g)
        for i, a in enumerate(ids):
            order = sorted((-round(float(s[i, j]), 12), b) for j, b in enumerate(ids) if j != i)[:10]
            want |= {(g, a, k): (b, round(-v, 9)) for k, (v, b) in enumerate(order, 1)}
    assert got == want


def test_two_sides_with_nulls_and_other_groups(spark):
    left = spark.createDataFrame([("x", "p", [1.0, 0.0]), ("x", "q", [0.6, 0.8]), ("x", None, [1.0, 0.0]), (None, "r", [1.0, 0.0]), ("w", "s", [1.0, 0.0]), ("x", "t", None)], "g string, id string, v array<double>")
    right = spark.createDataFrame([("x", "m", [0.0, 1.0]), ("x", "n", [1.0, 0.0]), ("y", "o", [1.0, 0.0])], "g string, id string, v array<double>")
    got = {tuple(r) for r in neighbours.similar_pairs(left, right, ["g"], "id", "v", k=1, least=0.7).collect()}
    assert got >= {("x", "p", "n", 1.0), ("x", "q", "m", 0.8)} and ("x", "p", "m", 0.0) not in got
    assert neighbours.similar_pairs(left.limit(0), None, ["g"], "id", "v").count() == 0


def brute_costs(s, samples):
    far = np.round(np.sqrt(np.maximum(0, 2 - 2 * np.round(s, 12))), density.DIGITS)
    n = len(far)
    core = np.array([sorted(np.delete(far[i], i))[min(samples, n - 1) - 1] for i in range(n)])
    return np.maximum(np.maximum(far, core[:, None]), core[None, :])


def pieces(nodes, cost, bar):
    """Components of nodes by edges cheaper than bar."""
    left, out = set(nodes), []
    while left:
        piece, stack = set(), [left.pop()]
        while stack:
            x = stack.pop()
            piece.add(x)
            near = {y for y in left if cost[x, y] < bar}
            left -= near
            stack += near
        out.append(frozenset(piece))
    return out


def brute_labels(cost, least):
    """Clusters by taking components apart at every distance, the largest first."""
    n = len(cost)
    bars = sorted({cost[i, j] for i in range(n) for j in range(i)}, reverse=True)

    def follow(nodes, born, at):
        """(stability, points with the density they leave at, clusters below) of a cluster."""
        stability, left, current = 0.0, {}, nodes
        for k in range(at, len(bars)):
            level = 1 / max(bars[k], density.LEAST_DISTANCE)
            parts = pieces(current, cost, bars[k])
            if len(parts) == 1:
                continue
            large = [p for p in parts if len(p) >= least]
            for p in parts:
                if len(p) < least:
                    left |= dict.fromkeys(p, level)
                    stability += len(p) * (level - born)
            if len(large) > 1:
                stability += sum(map(len, large)) * (level - born)
                return stability, left, [follow(p, level, k + 1) for p in large]
            if not large:
                return stability, left, []
            current = large[0]
        return stability, left, []

    def take(cluster):
        stability, left, below = cluster
        inner = [take(c) for c in below]
        if not below or stability >= sum(w for w, _ in inner):
            held, stack = dict(left), list(below)
            while stack:
                c = stack.pop()
                held |= c[1]
                stack += c[2]
            return stability, [held]
        return sum(w for w, _ in inner), [h for _, hs in inner for h in hs]

    root = follow(frozenset(range(n)), 0.0, 0)
    chosen = [h for c in root[2] for h in take(c)[1]]
    labels = [(-1, 0.0)] * n
    for label, held in enumerate(sorted(chosen, key=lambda h: (-len(h), min(h)))):
        for x, level in held.items():
            labels[x] = (label, round(level / max(held.values()), 6))
    return labels


@pytest.mark.parametrize(("k", "seed"), [(6, 1), (64, 2)])
def test_clusters_equal_brute_force(spark, k, seed):
    """Short lists of neighbours leave edges to the search of whole groups; long ones don't. Neither changes a cluster."""
    rows, df = table(spark, {"x": 48, "y": 30, "z": 3, "one": 1}, seed=seed)
    got = {r.id: (r.micro_topic_id, r.micro_topic_probability) for r in density.density_clusters(df, ["g"], "id", "v", 5, k).collect()}
    assert len(got) == len(rows)
    for g in ("x", "y", "z", "one"):
        ids, s = sims(rows, g)
        want = brute_labels(brute_costs(s, 5), 5) if len(ids) > 1 else [(-1, 0.0)]
        assert [got[i][0] for i in ids] == [w[0] for w in want]
        assert [got[i][1] for i in ids] == pytest.approx([w[1] for w in want], abs=2e-6)
    assert len({v[0] for v in got.values()}) > 2


def test_tree_connects_as_all_pairs_do(spark):
    rows, df = table(spark, {"x": 70}, seed=5)
    points = df.select("g", F.col("id").alias("node"), F.col("v").alias("vector"))
    samples = spark.createDataFrame([("x", 70, 4)], "g string, n long, samples int")
    tree = density.spanning_tree(points, ["g"], samples, 5).collect()
    ids, s = sims(rows, "x")
    cost = brute_costs(s, 4)
    own = np.full(cost.shape, np.inf)
    for r in tree:
        own[ids.index(r.a), ids.index(r.b)] = own[ids.index(r.b), ids.index(r.a)] = r.cost
    for bar in sorted({r.cost for r in tree}):
        assert set(pieces(range(70), own, bar)) == set(pieces(range(70), cost, bar))


def test_noise_alone_and_copies():
    labels, firm = density.condensed_labels([(0, 1, 0.0), (1, 2, 0.0), (3, 4, 0.0), (4, 5, 0.0), (2, 3, 1.0)], 6, 3)
    assert labels.tolist() == [0, 0, 0, 1, 1, 1] and firm.tolist() == [1.0] * 6
    assert density.condensed_labels([(0, 1, 0.5)], 2, 5)[0].tolist() == [-1, -1]
    assert density.condensed_labels([], 1, 5)[0].tolist() == [-1]
    assert Counter(density.condensed_labels([(i, i + 1, 0.1) for i in range(9)], 10, 3)[0].tolist()) == {-1: 10}
