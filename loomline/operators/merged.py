"""Merged groups of topics: what their members add up to, in all and by year; and the tables of a review of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lists import stable_unique
from .relational import top_by

# What is said of a group's members, and how many terms, chunks, summaries and yearly words are shown.
NOTES = ("Single original microtopic retained.", "Multiple original microtopics grouped with partially distinct refined labels.", "Multiple original microtopics grouped under a consistent refined label family.")
MOST_TERMS, MOST_CHUNKS, MOST_SUMMARIES, MOST_YEAR_WORDS, MOST_RECORDS, SPARSE = 15, 5, 4, 10, 5, 5


def _in_order(order: Column, value: str) -> Column:
    """Aggregate: a column's values in the order of the members."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def group_metadata(members: DataFrame, within: list[str], group: str, member: str) -> DataFrame:
    """A row per merged group of a subgroup (within).

    members: within, group, member, label, summary, is_ready, topic_size, years, terms and chunks (lists). Members stand in
    the order of their names. topic_size, share_of_non_outlier and cumulative_share (the larger groups first, of equal
    ones the lower name) are over the subgroup's members.
    """
    order = F.col(member)
    joined = lambda c: F.flatten(_in_order(order, c))
    labels = stable_unique(_in_order(order, "label"))
    facts = members.groupBy(*within, group).agg(
        F.count(F.lit(1)).alias("group_size"), F.sum("topic_size").alias("topic_size"), F.to_json(F.array_sort(F.collect_set(order))).alias("member_topics_json"), F.size(labels).alias("_labels"),
        F.to_json(stable_unique(_in_order(order, "summary"), MOST_SUMMARIES)).alias("member_overall_summaries_json"), F.array_sort(F.array_distinct(joined("years"))).alias("_years"),
        F.to_json(stable_unique(joined("terms"), MOST_TERMS)).alias("overall_keywords"), F.to_json(stable_unique(joined("chunks"), MOST_CHUNKS)).alias("representative_chunks_json"), F.count_if("is_ready").alias("narrative_ready_member_count"),
    )
    whole = members.groupBy(*within).agg(F.sum("topic_size").alias("_all"))
    rows = facts.join(whole, within)
    so_far = Window.partitionBy(*within).orderBy(F.desc("topic_size"), group).rowsBetween(Window.unboundedPreceding, 0)  # the groups of one subgroup
    note = F.when(F.col("group_size") == 1, NOTES[0]).when(F.col("_labels") > 1, NOTES[1]).otherwise(NOTES[2])
    rows = rows.withColumns({
        "is_singleton_group": F.col("group_size") == 1, "share_of_non_outlier": F.round(F.col("topic_size") / F.col("_all"), 6), "cumulative_share": F.round(F.sum("topic_size").over(so_far) / F.col("_all"), 6),
        "active_year_count": F.size("_years"), "active_year_min": F.get("_years", 0), "active_year_max": F.try_element_at("_years", F.lit(-1)), "years_present_json": F.to_json("_years"), "heterogeneity_note": note,
    })
    return rows.drop("_all", "_years", "_labels")


def year_evidence(chunks: DataFrame, keys: list[str], order: list[Column], words: str, record: Column, chunk_id: Column) -> DataFrame:
    """Per merged group and year (keys): chunks, whether they are few, the words of its best chunks and the best chunks themselves.

    words: a column of one word per chunk; the first ten different ones of the best chunks are shown.
    """
    counts = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("available_chunk_count"))
    best = top_by(chunks.withColumn("_r", record).withColumn("_id", chunk_id), keys, order, MOST_RECORDS, "k")
    packed = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "_r", "_id"))), lambda x: F.struct(x["_r"].alias("r"), x["_id"].alias("id"))).alias("p"))
    first = chunks.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).groupBy(*keys, words).agg(F.min("k").alias("k"))
    shown = first.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("k", words))), 1, MOST_YEAR_WORDS), lambda x: x[words]).alias("w"))
    ids = [F.coalesce(F.get("p", i)["id"], F.lit("")).alias(f"chunk_id_{i + 1}") for i in range(MOST_RECORDS)]
    out = counts.join(packed, keys).join(shown, keys)
    return out.select(*keys, "available_chunk_count", (F.col("available_chunk_count") < SPARSE).alias("is_sparse_year"), F.to_json("w").alias("year_specific_words"), F.to_json(F.transform("p", lambda x: x["r"])).alias("chunk_records_json"), *ids)


def hybrid_review(included: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """What reviewers get: external topics linked to an anchor, anchors that no kept topic is linked to, and the backlog.

    included: serving.include_by_best of the external topics. anchors: key and their own columns. bucket says which of
    the three tables a row is of; a linked row has its anchor, a backlog row the best one it has, and neither a decision.
    """
    linked = F.col("is_included")
    rows = included.select(F.when(linked, "linked").otherwise("backlog").alias("bucket"), key, "source", "best_counterpart", "best_similarity", F.col("qualifying_pairs").alias("direct_pair_count"), "inclusion_reason")
    used = included.where(linked).select(F.col("best_counterpart").alias(key)).distinct()
    alone = anchors.join(used, key, "left_anti").select(F.lit("unlinked_anchor").alias("bucket"), key, "source", F.lit(None).cast(rows.schema["best_counterpart"].dataType).alias("best_counterpart"), F.lit(None).cast("double").alias("best_similarity"), F.lit(0).cast("long").alias("direct_pair_count"), F.lit("no_external_counterpart").alias("inclusion_reason"))
    return rows.unionByName(alone).withColumns({"review_decision": F.lit(""), "review_notes": F.lit("")})
