"""Reviewers' decisions on trees of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decisions
from ..plans.corpus import table
from .comparisons import exclusion_review
from .registry import ORACLE_SQL, query

# A tree per kind of parts: n parts are leaves n to 2n - 1 in the order of their keys, node i holds nodes 2i and 2i + 1.
_TREE_SQL = """l AS (SELECT p_type AS grp, p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) + count(*) OVER (PARTITION BY p_type) - 1 AS node, count(*) OVER (PARTITION BY p_type) AS n FROM part),
m AS (SELECT grp, unnest(range(4, n)) AS node FROM (SELECT DISTINCT grp, n FROM l)),
dec AS (SELECT grp, node, CASE node % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 3 THEN 'review' END AS raw FROM m WHERE node % 7 IN (0, 1, 3, 5)),
eff AS (SELECT grp, node, coalesce(raw, '') AS raw, coalesce(raw, 'reject') AS decision FROM dec),
up(grp, node, anc, depth) AS (SELECT grp, node, node, 0 FROM (SELECT grp, node FROM l UNION SELECT grp, node FROM m) UNION ALL SELECT grp, node, anc // 2, depth + 1 FROM up WHERE anc > 1)"""
_MAP_SQL = f"""{_TREE_SQL}, ruled AS (
  SELECT l.grp, l.node, l.p_partkey, arg_max(e.node, depth) FILTER (decision = 'accept') AS accepted, arg_min(e.node, depth) FILTER (decision = 'review') AS reviewed, arg_min(e.node, depth) FILTER (decision IS NOT NULL) AS decided, arg_min(raw, depth) FILTER (decision IS NOT NULL) AS raw
  FROM l JOIN up USING (grp, node) LEFT JOIN eff e ON e.grp = up.grp AND e.node = up.anc GROUP BY ALL
), kinds AS (
  SELECT *, CASE WHEN reviewed IS NOT NULL THEN 'review' WHEN accepted IS NOT NULL THEN 'accept' WHEN decided IS NULL THEN 'none' WHEN raw = '' THEN 'blank' ELSE 'reject' END AS kind FROM ruled
), final AS (
  SELECT *, CASE kind WHEN 'review' THEN grp || '_M' || (node // 2) WHEN 'accept' THEN grp || '_B' || lpad(CAST(accepted AS VARCHAR), CAST(greatest(3, length(CAST(accepted AS VARCHAR))) AS INTEGER), '0') ELSE grp || '_S' || lpad(CAST(node AS VARCHAR), CAST(greatest(3, length(CAST(node AS VARCHAR))) AS INTEGER), '0') END AS final_merge_group_id,
    CASE kind WHEN 'review' THEN 'hierarchical_review_manual' WHEN 'accept' THEN 'hierarchical_accept' WHEN 'none' THEN 'no_branchlet_singleton' WHEN 'blank' THEN 'hierarchical_blank_default_reject' ELSE 'hierarchical_reject_singleton' END AS decision_source,
    CASE kind WHEN 'none' THEN 'singleton_auto' WHEN 'blank' THEN 'reject' ELSE kind END AS effective_group_decision,
    CASE kind WHEN 'review' THEN reviewed WHEN 'accept' THEN accepted ELSE decided END AS branch
  FROM kinds
), mapped AS (
  SELECT *, count(*) OVER (PARTITION BY final_merge_group_id) AS group_size FROM final
)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves, merges and decisions; a kind of parts is far too small for its window to weigh."""
    own = Window.partitionBy("p_type")
    parts = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_name")
    n = F.count(F.lit(1)).over(own)
    leaves = parts.select(F.col("p_type").alias("group"), (F.row_number().over(own.orderBy("p_partkey")) + n - 1).cast("long").alias("node"), "p_partkey", "p_name", n.alias("n"))
    inner = leaves.select("group", "n").distinct().where("n > 1").select("group", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("parent"))
    tree = inner.select("group", "parent", (F.col("parent") * 2).alias("left"), (F.col("parent") * 2 + 1).alias("right"))
    kind = F.col("parent") % 7
    word = F.when(kind == 0, "accept").when(kind == 1, " Reject").when(kind == 3, "REVIEW ").otherwise("")
    said = inner.where((F.col("parent") >= 4) & kind.isin(0, 1, 3, 5)).select("group", F.col("parent").alias("node"), word.alias("decision"))
    manual = F.concat("group", F.lit("_M"), F.floor(F.col("node") / 2).cast("string"))
    return leaves.drop("n").withColumn("manual_review_group_id", manual), tree, said


@query(f"WITH RECURSIVE {_MAP_SQL} SELECT grp AS \"group\", p_partkey, final_merge_group_id, group_size, group_size = 1 AS is_singleton_group, decision_source, effective_group_decision, coalesce(CAST(branch AS VARCHAR), '') AS proposed_branchlet_id FROM mapped")
def hierarchical_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on nodes of trees, nested in each other, as final groups of the parts."""
    out = decisions.hierarchical_mapping(*_inputs(spark, sf_dir))
    return out.select("group", "p_partkey", "final_merge_group_id", "group_size", "is_singleton_group", "decision_source", "effective_group_decision", "proposed_branchlet_id")


@query(
    f"""WITH RECURSIVE {_MAP_SQL} SELECT grp AS "group", final_merge_group_id, max(group_size) AS group_size, max(group_size) = 1 AS is_singleton_group, to_json(list(DISTINCT node ORDER BY node)) AS group_members_json,
to_json(list(DISTINCT decision_source ORDER BY decision_source)) AS decision_sources, to_json(list(DISTINCT effective_group_decision ORDER BY effective_group_decision)) AS effective_group_decisions FROM mapped GROUP BY ALL"""
)
def hierarchical_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final groups with their members and what made them."""
    return decisions.group_roster(decisions.hierarchical_mapping(*_inputs(spark, sf_dir)))


@query(f"WITH RECURSIVE {_TREE_SQL}, a AS (SELECT up.grp, up.node, up.anc, depth FROM up JOIN eff x ON x.grp = up.grp AND x.node = up.node JOIN eff y ON y.grp = up.grp AND y.node = up.anc WHERE depth > 0 AND x.decision = 'accept' AND y.decision = 'accept'), k AS (SELECT grp, anc AS node, count(*) AS leaf_count FROM up JOIN l USING (grp, node) GROUP BY ALL) SELECT a.grp AS \"group\", a.node, arg_max(a.anc, a.depth) AS ancestor, max(leaf_count) AS leaf_count FROM a JOIN k ON k.grp = a.grp AND k.node = a.node GROUP BY ALL")
def accept_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted nodes that an accepted ancestor overrules, with how many leaves they hold."""
    _, tree, said = _inputs(spark, sf_dir)
    return decisions.accept_conflicts(decisions.interval_labels(tree), decisions.read_decisions(said))


@query(
    f"""WITH ex AS ({ORACLE_SQL["exclusion_review"]}), sh AS (SELECT topic_id, CASE CAST(replace(brand, 'Brand#', '') AS INTEGER) % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'not related' END AS decision FROM ex)
SELECT topic_id, documents, counterparts, coalesce(decision, '') AS review_decision, CASE WHEN decision IS NULL THEN '' WHEN documents % 2 = 0 THEN 'first || second' ELSE 'first' END AS review_note, decision IS NOT NULL AS is_imported FROM ex JOIN sh USING (topic_id)"""
)
def imported_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review sheet with the decisions that came back, on some rows twice."""
    review = exclusion_review(spark, sf_dir)
    n = F.replace("brand", F.lit("Brand#"), F.lit("")).cast("int") % 7
    word = F.when(n == 0, " DELETE").when(n == 1, "Not  related").otherwise(" ")
    one = review.select("topic_id", word.alias("review_decision"), F.lit("first").alias("review_note"), "documents")
    two = one.where("documents % 2 = 0").withColumn("review_note", F.lit(" second "))
    sheet = one.unionByName(two).drop("documents")
    return decisions.import_decisions(review, sheet, "topic_id").select("topic_id", "documents", "counterparts", "review_decision", "review_note", "is_imported")
