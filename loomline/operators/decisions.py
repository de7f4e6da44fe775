"""Decisions of reviewers on the nodes of merge trees, carried down to final groups of leaves.

A tree of merges is labelled by an Euler tour. Its list is shortened by a third in each round until pointers of what is left
are doubled, so a chain as deep as the tree is large takes as few rounds as a balanced one. What rules a leaf is folded along its path to the root in the same
way: the outermost accepted node, the deepest one under manual review, the nearest one with any decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, review_decision
from ..storage import join_bounded, stored
from .relational import ContractError, require_empty, require_unique

# What a reviewer may decide on a proposed group, and what is said about each leaf.
DECISIONS = ("accept", "reject", "review")
SOURCES = {"accept": "hierarchical_accept", "reject": "hierarchical_reject_singleton", "blank": "hierarchical_blank_default_reject", "review": "hierarchical_review_manual", "none": "no_branchlet_singleton"}
#: Doublings after which pointers still move only if the merges are no forest.
ROUNDS = 48
#: Places of tours that are ranked by doubling.
FEW_PLACES = 100_000


def children(tree: DataFrame) -> DataFrame:
    """group, node, parent, sibling (of a left child) of merges (group, parent, left, right); each node has one parent."""
    sides = tree.select("group", "parent", F.explode(F.array(F.struct(F.col("left").alias("node"), F.col("right").alias("sibling")), F.struct(F.col("right").alias("node"), F.lit(None).cast(tree.schema["left"].dataType).alias("sibling")))).alias("c"))
    return require_unique(stored(sides.select("group", "c.node", "parent", "c.sibling")), ["group", "node"])


def _tour(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (group, node), and the places of the tours of their trees.

    A place: group, node, side (0: enter, 1: leave, 2: both, of a leaf), prev and next with their sides, and w, how many
    steps it is to the next one.
    """
    kind = tree.schema["parent"].dataType
    sides = tree.select("group", "parent", F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit(None).cast(kind).alias("before"), F.col("right").alias("behind")), F.struct(F.col("right").alias("node"), F.col("left").alias("before"), F.lit(None).cast(kind).alias("behind")))).alias("c"))
    below = require_unique(stored(sides.select("group", "c.node", "parent", "c.before", "c.behind")), ["group", "node"])
    merges = tree.select("group", F.col("parent").alias("node"), "left", "right")
    nodes = below.select("group", "node").unionByName(merges.select("group", "node")).distinct()
    # Whether the neighbours on the tour are leaves says which of their places it is.
    inner = merges.select("group", "node").distinct()
    is_inner = lambda rows, c: rows.join(inner.select("group", F.col("node").alias(c), F.lit(True).alias(f"_{c}")), ["group", c], "left")
    facts = nodes.join(below, ["group", "node"], "left").join(merges, ["group", "node"], "left")
    for c in ("before", "behind", "left", "right"):
        facts = is_inner(facts, c)
    first, last = (lambda c: F.when(F.col(f"_{c}"), 0).otherwise(2)), (lambda c: F.when(F.col(f"_{c}"), 1).otherwise(2))
    place = lambda c, side: F.struct(F.col(c).alias("node"), side.cast("int").alias("side"))
    up = lambda side: F.when(F.col("parent").isNotNull(), place("parent", F.lit(side)))
    come = F.when(F.col("before").isNotNull(), place("before", last("before"))).otherwise(up(0))
    go = F.when(F.col("behind").isNotNull(), place("behind", first("behind"))).otherwise(up(1))
    entry = lambda side, prev, next_: F.struct(F.lit(side).alias("side"), prev.alias("prev"), next_.alias("next"))
    both = F.array(entry(0, come, place("left", first("left"))), entry(1, place("right", last("right")), go))
    rows = facts.select("group", "node", F.explode(F.when(F.col("left").isNull(), F.array(entry(2, come, go))).otherwise(both)).alias("e"))
    flat = [F.col(f"e.{c}.{x}").alias(f"{c}_{x}") for c in ("prev", "next") for x in ("node", "side")]
    return nodes, stored(rows.select("group", "node", "e.side", *flat, F.when(F.col("e.next").isNull(), 0).when(F.col("e.side") == 2, 2).otherwise(1).cast("long").alias("w")))


def _without_some(rows: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """The places that stay, linked past the others, and the others: those whose hash is less than both neighbours', about a third."""
    draw = lambda c: F.xxhash64("group", f"{c}node", f"{c}side", F.lit(salt))
    ends = F.col("prev_node").isNotNull() & F.col("next_node").isNotNull()
    marked = rows.withColumn("_gone", ends & (draw("") < draw("prev_")) & (draw("") < draw("next_")))
    gone, links = marked.where("_gone").drop("_gone"), ["prev_node", "prev_side", "next_node", "next_side", "w"]
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(f"_{c}") for c in links]
    told = lambda to, of: gone.select("group", F.col(f"{to}_node").alias("node"), F.col(f"{to}_side").alias("side"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in links], *[(F.col(c) if c in of else F.lit(None).cast(rows.schema[c].dataType)).alias(f"_{c}") for c in links])
    every = marked.where("NOT _gone").select("group", "node", "side", *links, *nothing).unionByName(told("prev", links[2:])).unionByName(told("next", links[:2]))
    one = every.groupBy("group", "node", "side").agg(*[F.max(c).alias(c) for c in [*links, *(f"_{c}" for c in links)]])
    kept = one.select("group", "node", "side", *[F.coalesce(f"_{c}", c).alias(c) for c in links[:4]], (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
    return stored(kept), stored(gone.select("group", "node", "side", "next_node", "next_side", "w"))


def _ranked(rows: DataFrame) -> DataFrame:
    """group, node, side, root and after, the steps to the end of its tour, of places whose pointers are doubled."""
    ahead_of = F.struct(F.col("next_node").alias("node"), F.col("next_side").alias("side"))
    rows = rows.select("group", "node", "side", F.when(F.col("next_node").isNotNull(), ahead_of).alias("next"), F.col("w").alias("after"), F.when(F.col("next_node").isNull(), F.col("node")).alias("root"))
    for _ in range(ROUNDS):
        open_rows = rows.where(F.col("next").isNotNull())
        if not open_rows.take(1):
            return rows.drop("next")
        ahead = rows.select("group", F.struct("node", "side").alias("next"), F.col("next").alias("_next"), F.col("after").alias("_after"), F.col("root").alias("_root"))
        moved = open_rows.join(ahead, ["group", "next"]).select("group", "node", "side", F.col("_next").alias("next"), (F.col("after") + F.col("_after")).alias("after"), F.col("_root").alias("root"))
        rows = stored(rows.where(F.col("next").isNull()).unionByName(moved))
    raise ContractError("the merges do not form a forest")


def interval_labels(tree: DataFrame, few: int = FEW_PLACES) -> DataFrame:
    """group, node, root, first, last, leaf_count for the nodes of merges (group, parent, left, right).

    first and last are the places of entering and leaving a node on the tour of its tree, so a node is below another one
    of the same root if its interval is inside the other's. Up to few places are ranked by doubling; of more, a third
    leaves each round and gets its rank back from the next one, so what is moved grows with the places alone.
    """
    nodes, rows = _tour(tree)
    left_out: list[DataFrame] = []
    n = rows.count()
    while n > few and len(left_out) < 2 * ROUNDS:
        rows, gone = _without_some(rows, len(left_out))
        left_out.append(gone)
        n = rows.count()
    known = _ranked(rows)
    while left_out:
        ahead = known.select("group", F.col("node").alias("next_node"), F.col("side").alias("next_side"), "after", "root")
        back = left_out.pop().join(ahead, ["group", "next_node", "next_side"]).select("group", "node", "side", (F.col("w") + F.col("after")).alias("after"), "root")
        known = known.unionByName(stored(back))
    came, went = F.when(F.col("side") != 1, F.col("after")), F.when(F.col("side") == 1, F.col("after")).when(F.col("side") == 2, F.col("after") - 1)
    both = known.groupBy("group", "root", "node").agg(F.max(came).alias("_in"), F.max(went).alias("_out"))
    both = stored(both)
    if both.where(F.col("root").isNull()).take(1) or both.count() != nodes.count():
        raise ContractError("the merges do not form a forest")
    whole = both.where(F.col("node") == F.col("root")).select("group", "root", F.col("_in").alias("_whole"))
    placed = join_bounded(both, whole, ["group", "root"])
    first, last = F.col("_whole") - F.col("_in"), F.col("_whole") - F.col("_out")
    return stored(placed.select("group", "node", "root", first.alias("first"), last.alias("last"), ((last - first + 3) / 4).cast("long").alias("leaf_count")))


def path_state(tree: DataFrame, decisions: DataFrame) -> DataFrame:
    """group, node, accepted (the outermost on the path to the root), reviewed (the deepest), decided (the nearest), NULL where there is none.

    decisions: group, node, decision. The path has the node itself.
    """
    below = children(tree)
    tops = tree.select("group", F.col("parent").alias("node")).join(below.select("group", "node"), ["group", "node"], "left_anti")
    nodes = below.select("group", "node", "parent").unionByName(tops.select("group", "node", F.lit(None).cast(tree.schema["parent"].dataType).alias("parent")))
    own = nodes.join(decisions.select("group", "node", "decision"), ["group", "node"], "left")
    mark = lambda kind: F.when(F.col("decision") == kind, F.col("node"))
    rows = stored(own.select("group", "node", F.col("parent").alias("up"), mark("accept").alias("accepted"), mark("review").alias("reviewed"), F.when(F.col("decision").isNotNull(), F.col("node")).alias("decided")))
    for _ in range(ROUNDS):
        open_rows = rows.where(F.col("up").isNotNull())
        if not open_rows.take(1):
            return rows.drop("up")
        above = rows.select("group", F.col("node").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in ("accepted", "reviewed", "decided")])
        moved = open_rows.join(above, ["group", "up"])
        moved = moved.select("group", "node", F.col("_up").alias("up"), F.coalesce("_accepted", "accepted").alias("accepted"), F.coalesce("reviewed", "_reviewed").alias("reviewed"), F.coalesce("decided", "_decided").alias("decided"))
        rows = stored(rows.where(F.col("up").isNull()).unionByName(moved))
    raise ContractError("the merges do not form a forest")


def read_decisions(decisions: DataFrame, blank: str = "reject") -> DataFrame:
    """group, node, raw, decision, notes: the reviewer's words in lower case, blank ones as the default; others are refused."""
    if blank not in DECISIONS:
        raise ContractError(f"unknown default decision: {blank}")
    raw = clean_text(F.col("decision"))
    notes = clean_text(F.col("notes")) if "notes" in decisions.columns else F.lit("")
    out = decisions.select("group", "node", raw.alias("raw"), F.when(raw == "", blank).otherwise(F.lower(raw)).alias("decision"), notes.alias("notes"))
    require_empty(out.where(~F.col("decision").isin(*DECISIONS)), "an unknown decision")
    return require_unique(out, ["group", "node"])


def accept_conflicts(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """group, node, ancestor: accepted nodes inside another accepted one, with the outermost such one, which rules.

    labels: interval_labels. Accepted intervals of a tree are taken in order: one begins a new outermost interval if it
    ends behind all before it.
    """
    accepted = decisions.where(F.col("decision") == "accept").select("group", "node").join(labels, ["group", "node"])
    before = Window.partitionBy("group", "root").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ranked = accepted.withColumn("_behind", F.coalesce(F.max("last").over(before), F.lit(-1)))
    outer = F.when(F.col("last") > F.col("_behind"), F.col("node"))
    so_far = Window.partitionBy("group", "root").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("ancestor", F.last(outer, ignorenulls=True).over(so_far)).where(F.col("last") <= F.col("_behind")).select("group", "node", "ancestor", "leaf_count")


def hierarchical_mapping(leaves: DataFrame, tree: DataFrame, decisions: DataFrame, blank: str = "reject") -> DataFrame:
    """Each leaf with its final group.

    leaves: group, node, manual_review_group_id, and any other columns; a leaf outside every tree is a singleton.
    A leaf under a node that is reviewed goes to the group that its reviewer named, which must not be blank, even below an
    accepted node; else under an accepted node to the outermost one's group; else it stays alone. A name that reviewers
    give must not be used under two reviewed nodes of a group of trees. decision_source says which rule it was.
    """
    read = stored(read_decisions(decisions, blank))
    paths = path_state(tree, read)
    rows = require_unique(leaves, ["group", "node"]).join(paths, ["group", "node"], "left")
    said = read.select("group", F.col("node").alias("decided"), F.col("raw").alias("group_decision_raw"), F.col("notes").alias("group_review_notes"))
    rows = join_bounded(rows, said, ["group", "decided"], "left")
    manual = clean_text(F.col("manual_review_group_id"))
    kind = F.when(F.col("reviewed").isNotNull(), "review").when(F.col("accepted").isNotNull(), "accept").when(F.col("decided").isNull(), "none").when(F.col("group_decision_raw") == "", "blank").otherwise("reject")
    alone = F.concat(F.col("group").cast("string"), F.lit("_S"), _three(F.col("node")))
    merged = F.concat(F.col("group").cast("string"), F.lit("_B"), _three(F.col("accepted")))
    rows = stored(rows.withColumn("_kind", kind).withColumn("_manual", manual))
    require_empty(rows.where((F.col("_kind") == "review") & (F.col("_manual") == "")), "a reviewed leaf without a manual group")
    reused = rows.where(F.col("_kind") == "review").groupBy("group", "_manual").agg(F.count_distinct("reviewed").alias("n")).where("n > 1")
    require_empty(reused, "a manual group under several reviewed nodes")
    final = F.when(F.col("_kind") == "review", F.col("_manual")).when(F.col("_kind") == "accept", merged).otherwise(alone)
    rows = rows.withColumn("final_merge_group_id", final).withColumn("decision_source", F.coalesce(*[F.when(F.col("_kind") == k, v) for k, v in SOURCES.items()]))
    branch = F.when(F.col("_kind") == "review", F.col("reviewed")).when(F.col("_kind") == "accept", F.col("accepted")).otherwise(F.col("decided"))
    rows = rows.withColumn("proposed_branchlet_id", F.coalesce(branch.cast("string"), F.lit(""))).withColumn("effective_group_decision", F.when(F.col("_kind") == "none", "singleton_auto").when(F.col("_kind") == "blank", blank).otherwise(F.col("_kind")))
    sizes = rows.groupBy("final_merge_group_id").agg(F.count(F.lit(1)).alias("group_size"), F.count_distinct("group").alias("_groups"))
    sizes = stored(sizes)
    require_empty(sizes.where("_groups > 1"), "a final group in several groups of trees")
    out = join_bounded(rows, sizes.drop("_groups"), ["final_merge_group_id"])
    return out.withColumn("is_singleton_group", F.col("group_size") == 1).drop("_kind", "_manual", "accepted", "reviewed", "decided")


def _three(node: Column) -> Column:
    """A number with three digits at least; other names as they are."""
    text = node.cast("string")
    return F.when(text.rlike("^[0-9]{1,2}$"), F.lpad(text, 3, "0")).otherwise(text)


def group_roster(mapping: DataFrame, name: Column | None = None) -> DataFrame:
    """A row per final group: size, members in order, what they were decided by, as JSON lists of sorted distinct values."""
    listed = lambda c: F.to_json(F.array_sort(F.collect_set(c)))
    title = [] if name is None else [listed(F.nullif(clean_text(name), F.lit(""))).alias("member_topic_names")]
    return mapping.groupBy("group", "final_merge_group_id").agg(F.max("group_size").alias("group_size"), F.max("is_singleton_group").alias("is_singleton_group"), listed(F.col("node")).alias("group_members_json"), *title, listed(F.col("decision_source")).alias("decision_sources"), listed(F.col("effective_group_decision")).alias("effective_group_decisions"))


def import_decisions(review: DataFrame, sheet: DataFrame, key: str) -> DataFrame:
    """The review's rows with the decisions and notes of a sheet that came back, and whether they are from it.

    sheet: key, review_decision, review_note; several sheets may be put together. Blank decisions change nothing. A word
    that is no decision, a key that the review hasn't, and a key with different decisions are refused; a key that several
    rows decide alike has their notes, sorted.
    """
    said = clean_text(F.col("review_decision"))
    rows = sheet.select(key, said.alias("_said"), review_decision(said).alias("_decision"), clean_text(F.col("review_note")).alias("_note")).where(F.col("_said") != "")
    require_empty(rows.where(F.col("_decision") == ""), "an unknown decision")
    rows = stored(rows)
    require_empty(join_bounded(rows, review.select(key).distinct(), [key], "left_anti"), "a decision on an unknown row")
    one = rows.groupBy(key).agg(F.count_distinct("_decision").alias("_n"), F.min("_decision").alias("_decision"), F.array_join(F.array_sort(F.collect_set(F.nullif("_note", F.lit("")))), " || ").alias("_note"))
    one = stored(one)
    require_empty(one.where("_n > 1"), "different decisions on a row")
    out = join_bounded(review, one.drop("_n"), [key], "left")
    return out.withColumns({"review_decision": F.coalesce("_decision", "review_decision"), "review_note": F.coalesce("_note", "review_note"), "is_imported": F.col("_decision").isNotNull()}).drop("_decision", "_note")
