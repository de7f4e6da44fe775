"""Merged groups of topics and reviews of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merged, serving
from ..operators.relational import top_by
from ..plans.corpus import BASE_SQL, chunks
from .registry import query
from .vectors import _MNN_SQL, cross_source, embedded

# Topics of a brand of sizes up to 25 are merged, the others stay alone.
WITHIN = ["source", "macro_topic"]
_GROUP_SQL = f"""{BASE_SQL}, g AS (SELECT *, CAST(split_part(topic, '/', 2) AS INTEGER) AS size_no, brand || CASE WHEN CAST(split_part(topic, '/', 2) AS INTEGER) <= 25 THEN '_PG' ELSE '_S' || lpad(split_part(topic, '/', 2), 3, '0') END AS final_merge_group_id, CAST(document_id AS VARCHAR) || '::chunk_' || lpad(CAST(item AS VARCHAR), 4, '0') AS chunk_id FROM base
), mem AS (SELECT source, macro_topic, final_merge_group_id, topic, any_value(CASE WHEN size_no % 2 = 0 THEN brand ELSE topic END) AS label, count(*) AS topic_size, list(DISTINCT year ORDER BY year) AS years FROM g GROUP BY ALL
), ch AS (SELECT source, macro_topic, topic, list(chunk_id ORDER BY k) AS chunks, list('part ' || part_id ORDER BY k) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY source, macro_topic, topic ORDER BY score DESC, document_id, item, part_id) AS k FROM g) WHERE k <= 3 GROUP BY ALL
)"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their topic's final group."""
    size = F.split("topic", "/")[1]
    suffix = F.when(size.cast("int") <= 25, "_PG").otherwise(F.concat(F.lit("_S"), F.lpad(size, 3, "0")))
    return chunks(spark, sf_dir).withColumns({"size_no": size.cast("int"), "final_merge_group_id": F.concat("brand", suffix), "chunk_id": text.chunk_id(F.col("document_id"), F.col("item"))})


def _order() -> list:
    return [F.desc("score"), F.col("document_id"), F.col("item"), F.col("part_id")]


_UNIQUE = "list_filter({c}, lambda x, i: list_position({c}, x) = i)[1:{n}]"


@query(
    f"""WITH {_GROUP_SQL}, j AS (SELECT m.*, chunks, terms FROM mem m JOIN ch USING (source, macro_topic, topic)
), a AS (SELECT source, macro_topic, final_merge_group_id, count(*) AS group_size, CAST(sum(topic_size) AS BIGINT) AS topic_size, to_json(list(topic ORDER BY topic)) AS member_topics_json, count(DISTINCT label) AS labels, list(topic || ' has ' || topic_size ORDER BY topic) AS sums, flatten(list(terms ORDER BY topic)) AS ts, flatten(list(chunks ORDER BY topic)) AS cs, list_sort(list_distinct(flatten(list(years)))) AS ys, count(*) FILTER (topic_size % 5 <> 0) AS narrative_ready_member_count FROM j GROUP BY ALL
)
SELECT source, macro_topic, final_merge_group_id, group_size, topic_size, member_topics_json, to_json(sums[1:4]) AS member_overall_summaries_json, to_json({_UNIQUE.format(c="ts", n=15)}) AS overall_keywords, to_json({_UNIQUE.format(c="cs", n=5)}) AS representative_chunks_json, narrative_ready_member_count, group_size = 1 AS is_singleton_group,
  round(topic_size / sum(topic_size) OVER (PARTITION BY source, macro_topic), 6) AS share_of_non_outlier, round(sum(topic_size) OVER (PARTITION BY source, macro_topic ORDER BY topic_size DESC, final_merge_group_id ROWS UNBOUNDED PRECEDING) / sum(topic_size) OVER (PARTITION BY source, macro_topic), 6) AS cumulative_share,
  CAST(len(ys) AS INTEGER) AS active_year_count, ys[1] AS active_year_min, ys[-1] AS active_year_max, to_json(ys) AS years_present_json, CASE WHEN group_size = 1 THEN 'Single original microtopic retained.' WHEN labels > 1 THEN 'Multiple original microtopics grouped with partially distinct refined labels.' ELSE 'Multiple original microtopics grouped under a consistent refined label family.' END AS heterogeneity_note FROM a"""
)
def merged_group_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the topics of each final group add up to."""
    rows = grouped(spark, sf_dir)
    keys = [*WITHIN, "topic"]
    best = top_by(rows, keys, _order(), 3, "k").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "chunk_id", F.concat(F.lit("part "), F.col("part_id").cast("string")).alias("term")))).alias("b"))
    members = rows.groupBy(*WITHIN, "final_merge_group_id", "topic", "brand", "size_no").agg(F.count(F.lit(1)).alias("topic_size"), F.array_sort(F.collect_set("year")).alias("years")).join(best, keys)
    members = members.withColumns({"label": F.when(F.col("size_no") % 2 == 0, F.col("brand")).otherwise(F.col("topic")), "summary": F.concat("topic", F.lit(" has "), F.col("topic_size").cast("string")), "is_ready": F.col("topic_size") % 5 != 0, "terms": F.transform("b", lambda x: x["term"]), "chunks": F.transform("b", lambda x: x["chunk_id"])})
    return merged.group_metadata(members, WITHIN, "final_merge_group_id", "topic")


_YEAR_KEYS = "source, macro_topic, final_merge_group_id, year"


@query(
    f"""WITH {_GROUP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {_YEAR_KEYS} ORDER BY score DESC, document_id, item, part_id) AS k FROM g), w AS (SELECT {_YEAR_KEYS}, list(topic ORDER BY k)[1:10] AS ws FROM (SELECT {_YEAR_KEYS}, topic, min(k) AS k FROM r GROUP BY ALL) GROUP BY ALL)
SELECT {_YEAR_KEYS}, count(*) AS available_chunk_count, count(*) < 5 AS is_sparse_year, any_value(to_json(ws)) AS year_specific_words, to_json(list({{'chunk_id': chunk_id, 'document_id': document_id}} ORDER BY k) FILTER (k <= 5)) AS chunk_records_json, {", ".join(f"coalesce(max(chunk_id) FILTER (k = {i}), '') AS chunk_id_{i}" for i in range(1, 6))} FROM r JOIN w USING ({_YEAR_KEYS}) GROUP BY {_YEAR_KEYS}"""
)
def merged_year_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each final group and year, and their topics."""
    return merged.year_evidence(grouped(spark, sf_dir), [*WITHIN, "final_merge_group_id", "year"], _order(), "topic", F.struct("chunk_id", "document_id"), F.col("chunk_id"))


@query(
    f"""WITH {_MNN_SQL}, b AS (SELECT vec_id_a AS vec_id, vec_id_b AS c, similarity, row_number() OVER (PARTITION BY vec_id_a ORDER BY similarity DESC, vec_id_b) AS k, count(*) FILTER (similarity >= 0.20) OVER (PARTITION BY vec_id_a) AS n FROM mn),
x AS (SELECT e.vec_id, e.source, c, similarity, coalesce(n, 0) AS n FROM e LEFT JOIN b ON b.vec_id = e.vec_id AND k = 1 WHERE e.source <> 'corporate')
SELECT CASE WHEN n > 0 THEN 'linked' ELSE 'backlog' END AS bucket, vec_id, source, coalesce(c, -1) AS best_counterpart, similarity AS best_similarity, n AS direct_pair_count, CASE WHEN n > 0 THEN 'direct_pair_above_threshold' WHEN c IS NULL THEN 'no_pair' ELSE 'below_threshold' END AS inclusion_reason, '' AS review_decision, '' AS review_notes FROM x
UNION ALL SELECT 'unlinked_anchor', vec_id, source, -1, NULL, 0, 'no_external_counterpart', '', '' FROM e WHERE source = 'corporate' AND vec_id NOT IN (SELECT c FROM x WHERE n > 0)"""
)
def hybrid_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External topics with an anchor, anchors without one, and the backlog; -1 where there is no counterpart."""
    pairs = cross_source(spark, sf_dir, 1, 0.20).select(F.col("vec_id_a").alias("vec_id"), F.col("vec_id_b").alias("counterpart"), "similarity")
    rows = embedded(spark, sf_dir)
    included = serving.include_by_best(pairs, rows.where("source <> 'corporate'").select("vec_id", "source"), "vec_id", 0.20)
    return merged.hybrid_review(included, rows.where("source = 'corporate'").select("vec_id", "source"), "vec_id").fillna(-1, ["best_counterpart"])
