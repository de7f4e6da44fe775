"""Trees of merges and decisions on them, against walks over the tree."""

import random

import pytest

from loomline.operators import decisions
from loomline.operators.relational import ContractError


def forest(kind, seed, n):
    """Merges of n leaves 0 to n - 1: (parent, left, right), in a chain, at random, or in two trees."""
    draw, roots, merges, node = random.Random(seed), list(range(n)), [], n
    while len(roots) > (2 if kind == "two" else 1):
        i = 0 if kind == "chain" else draw.randrange(len(roots))
        a = roots.pop(i)
        b = roots.pop(0 if kind == "chain" else draw.randrange(len(roots)))
        merges.append((node, a, b))
        roots.insert(0, node)
        node += 1
    return merges


def walk(merges):
    """node -> (root, first, last, leaves below)."""
    kids = {p: (a, b) for p, a, b in merges}
    out, inner = {}, {c for k in kids.values() for c in k}
    for root in [p for p in kids if p not in inner]:
        at, stack = -1, [(root, False)]
        opened = {}
        while stack:
            node, done = stack.pop()
            at += 1
            if done:
                out[node] = (root, opened[node], at, 1 if node not in kids else out[kids[node][0]][3] + out[kids[node][1]][3])
                continue
            opened[node] = at
            stack.append((node, True))
            if node in kids:
                stack += [(kids[node][1], False), (kids[node][0], False)]
    return out


@pytest.mark.parametrize(("kind", "n"), [("chain", 70), ("random", 40), ("two", 30), ("random", 2)])
def test_intervals_equal_a_walk(spark, kind, n):
    merges = forest(kind, 3, n)
    tree = spark.createDataFrame([(g, *m) for g in ("x", "y") for m in merges], "group string, parent long, left long, right long")
    got = decisions.interval_labels(tree).collect()
    want = walk(merges)
    assert {(r.group, r.node): (r.root, r.first, r.last, r.leaf_count) for r in got} == {(g, k): v for g in ("x", "y") for k, v in want.items()}


def path(merges, node):
    up = {c: p for p, *kids in merges for c in kids}
    out = [node]
    while out[-1] in up:
        out.append(up[out[-1]])
    return out


@pytest.mark.parametrize(("kind", "seed"), [("chain", 1), ("random", 2), ("two", 3)])
def test_mapping_equals_a_walk(spark, kind, seed):
    draw, merges = random.Random(seed), forest(kind, seed, 50)
    said = {p: draw.choice(["accept", "Reject", "review", " ", "ACCEPT "]) for p, *_ in merges if draw.random() < 0.3}
    tree = spark.createDataFrame([("g", *m) for m in merges], "group string, parent long, left long, right long")
    marks = spark.createDataFrame([("g", k, v) for k, v in said.items()], "group string, node long, decision string")
    clean = {k: v.strip().lower() for k, v in said.items()}
    deepest = {x: next((a for a in path(merges, x) if clean.get(a) == "review"), None) for x in range(50)}
    named = [("g", x, f"m{deepest[x]}_{x % 2}" if deepest.get(x) is not None else None) for x in (*range(50), 777)]
    leaves = spark.createDataFrame(named, "group string, node long, manual_review_group_id string")
    got = {r.node: (r.final_merge_group_id, r.decision_source) for r in decisions.hierarchical_mapping(leaves, tree, marks).collect()}
    want = {777: ("g_S777", "no_branchlet_singleton")}
    for x in range(50):
        own = [a for a in path(merges, x) if a in clean]
        accepted = [a for a in own if clean[a] == "accept"]
        if deepest[x] is not None:
            want[x] = (f"m{deepest[x]}_{x % 2}", "hierarchical_review_manual")
        elif accepted:
            want[x] = (f"g_B{accepted[-1]:03d}", "hierarchical_accept")
        elif own:
            want[x] = (f"g_S{x:03d}", "hierarchical_blank_default_reject" if clean[own[0]] == "" else "hierarchical_reject_singleton")
        else:
            want[x] = (f"g_S{x:03d}", "no_branchlet_singleton")
    assert got == want
    conflicts = {(r.node, r.ancestor) for r in decisions.accept_conflicts(decisions.interval_labels(tree), decisions.read_decisions(marks)).collect()}
    outer = {a: [b for b in path(merges, a)[1:] if clean.get(b) == "accept"] for a in clean if clean[a] == "accept"}
    assert conflicts == {(a, up[-1]) for a, up in outer.items() if up}


def test_contracts(spark):
    tree = spark.createDataFrame([("g", 2, 0, 1)], "group string, parent long, left long, right long")
    leaves = spark.createDataFrame([("g", 0, "a"), ("g", 1, "")], "group string, node long, manual_review_group_id string")
    marks = lambda *rows: spark.createDataFrame([("g", *r) for r in rows], "group string, node long, decision string")
    with pytest.raises(ContractError, match="unknown decision"):
        decisions.read_decisions(marks((2, "perhaps")))
    with pytest.raises(ContractError, match="without a manual group"):
        decisions.hierarchical_mapping(leaves, tree, marks((2, "review")))
    two = spark.createDataFrame([("g", 4, 0, 1), ("g", 5, 2, 3)], "group string, parent long, left long, right long")
    same = spark.createDataFrame([("g", x, "a") for x in range(4)], "group string, node long, manual_review_group_id string")
    with pytest.raises(ContractError, match="several reviewed"):
        decisions.hierarchical_mapping(same, two, marks((4, "review"), (5, "review")))
    ring = spark.createDataFrame([("g", 1, 2, 3), ("g", 2, 1, 4)], "group string, parent long, left long, right long")
    for broken in (ring, tree.unionByName(tree.selectExpr("group", "9L AS parent", "left", "7L AS right"))):
        with pytest.raises(ContractError):
            decisions.interval_labels(broken)
    with pytest.raises(ContractError):
        decisions.read_decisions(marks((2, "")), "maybe")
    assert [r.decision for r in decisions.read_decisions(marks((2, None)), "accept").collect()] == ["accept"]


def test_sheets_that_come_back(spark):
    review = spark.createDataFrame([(i, "", "") for i in range(4)], "id int, review_decision string, review_note string")
    sheet = lambda *rows: spark.createDataFrame(rows, "id int, review_decision string, review_note string")
    got = decisions.import_decisions(review, sheet((0, "Delete ", "b"), (0, "delete", "a"), (1, None, "x"), (2, "NOT RELATED", None)), "id").collect()
    assert {r.id: (r.review_decision, r.review_note, r.is_imported) for r in got} == {0: ("delete", "a || b", True), 1: ("", "", False), 2: ("not related", "", True), 3: ("", "", False)}
    for rows, why in (([(0, "perhaps", "")], "unknown decision"), ([(9, "delete", "")], "unknown row"), ([(0, "delete", ""), (0, "not related", "")], "different decisions")):
        with pytest.raises(ContractError, match=why):
            decisions.import_decisions(review, sheet(*rows), "id")


@pytest.mark.parametrize(("kind", "n"), [("chain", 60), ("random", 50), ("two", 30)])
def test_shortened_tours_equal_a_walk(spark, kind, n):
    merges = forest(kind, 5, n)
    tree = spark.createDataFrame([(g, *m) for g in ("x", "y") for m in merges], "group string, parent long, left long, right long")
    got = decisions.interval_labels(tree, few=60).collect()
    assert {(r.group, r.node): (r.root, r.first, r.last, r.leaf_count) for r in got} == {(g, k): v for g in ("x", "y") for k, v in walk(merges).items()}


def test_a_third_of_the_places_leaves(spark):
    tree = spark.createDataFrame([("x", *m) for m in forest("chain", 5, 400)], "group string, parent long, left long, right long")
    rows = decisions._tour(tree)[1]
    kept, gone = decisions._without_some(rows, 0)
    assert kept.count() + gone.count() == rows.count() == 400 + 2 * 399
    assert 0.25 * rows.count() < gone.count() < 0.42 * rows.count()
