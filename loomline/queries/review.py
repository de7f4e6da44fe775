"""Review of matched topics: status, coverage, timing, funnels and cascaded exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists, numbers, text
from ..operators import series
from ..operators.relational import by_priority, diverse_top, first_by, pivot_counts, replace_changed, resume, without_either
from ..plans.corpus import BASE_SQL, MACRO_TOPICS, chunks, table
from ..storage import join_bounded
from .registry import query
from .series import _GAP_SQL, _SPEAR_SQL, gaps, spearman

STATUSES = ["aligned", "external_relevant_unpaired", "excluded"]

# A topic's decision comes from its brand's number, as a reviewer's would from the sheet.
_REVIEW_SQL = f"""{BASE_SQL}, review AS (
  SELECT DISTINCT source, macro_topic, brand, CASE CAST(replace(brand, 'Brand#', '') AS INTEGER) % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'not related' ELSE '' END AS decision FROM base WHERE source <> 'corporate'
), rv AS (
  SELECT *, CASE decision WHEN 'delete' THEN 'excluded' WHEN 'not related' THEN 'external_relevant_unpaired' ELSE 'aligned' END AS paper_status FROM review
)"""


def reviewed(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    n = F.replace("brand", F.lit("Brand#"), F.lit("")).cast("int") % 7
    decision = F.when(n == 0, " Delete").when(n == 1, "Not related ").otherwise("keep")
    base = chunks(spark, sf_dir) if base is None else base
    topics = base.where(F.col("source") != "corporate").select("source", "macro_topic", "brand").distinct()
    rows = topics.withColumn("decision", text.review_decision(decision))
    return rows.withColumn("paper_status", text.decision_status(F.col("decision")))


@query(
    f"""WITH {_REVIEW_SQL} SELECT m AS macro_topic, s AS paper_status, count(DISTINCT brand || source) AS topic_count, count(DISTINCT brand) FILTER (source = 'academic') AS academic_topic_count, count(DISTINCT brand) FILTER (source = 'media') AS media_topic_count
FROM (SELECT unnest(['T1', 'T2', 'T3', 'T4', 'T5', 'T6']) AS m) CROSS JOIN (SELECT unnest(['aligned', 'external_relevant_unpaired', 'excluded']) AS s) LEFT JOIN rv ON macro_topic = m AND paper_status = s GROUP BY ALL"""
)
def status_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics per macro topic and status on the complete grid."""
    grid = spark.createDataFrame([(m, s) for m in MACRO_TOPICS.values() for s in STATUSES], "macro_topic string, paper_status string")
    counts = reviewed(spark, sf_dir).groupBy("macro_topic", "paper_status").agg(F.count(F.lit(1)).alias("topic_count"), F.count_if(F.col("source") == "academic").alias("academic_topic_count"), F.count_if(F.col("source") == "media").alias("media_topic_count"))
    return grid.join(counts, ["macro_topic", "paper_status"], "left").fillna(0)


@query(f"WITH {_REVIEW_SQL} SELECT source, count(*) FILTER (paper_status = 'aligned') AS aligned, count(*) FILTER (paper_status = 'external_relevant_unpaired') AS external_relevant_unpaired, count(*) FILTER (paper_status = 'excluded') AS excluded FROM rv GROUP BY source")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_counts(reviewed(spark, sf_dir), ["source"], "paper_status", STATUSES)


@query(
    f"""WITH {_SPEAR_SQL}, active AS {_GAP_SQL.split("active AS", 1)[1]}
SELECT g.macro_topic, count(*) AS relation_count, count(spearman_r) AS valid_spearman_count, count(*) FILTER (spearman_r > 0) AS spearman_positive_count, count(*) FILTER (spearman_r < 0) AS spearman_negative_count,
  count(*) FILTER (spearman_p < 0.10) AS spearman_p_lt_10_count, count(*) FILTER (spearman_p < 0.05) AS spearman_p_lt_05_count, count(*) FILTER (first_active_year_gap > 0) AS external_first_count, count(*) FILTER (first_active_year_gap = 0) AS same_first_year_count,
  count(*) FILTER (peak_year_gap > 0) AS external_peak_first_count, count(*) FILTER (peak_year_gap < 0) AS corporate_peak_first_count, count(*) FILTER (peak_year_gap = 0) AS same_peak_year_count, round(median(peak_year_gap), 3) AS median_peak_year_gap
FROM gaps g JOIN (SELECT macro_topic, brand, source_a, spearman_r, p9 AS spearman_p FROM adj WHERE lag = 0) s ON s.macro_topic = g.macro_topic AND s.brand = g.brand AND s.source_a = external_source GROUP BY ALL"""
)
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-year correlations and gaps counted per macro topic."""
    same_year = spearman(spark, sf_dir).where("lag = 0").select(F.col("source_a").alias("external_source"), "macro_topic", "brand", "spearman_r", "spearman_p")
    rows = gaps(spark, sf_dir).join(same_year, ["external_source", "macro_topic", "brand"])
    r, p, first, peak = (F.col(c) for c in ("spearman_r", "spearman_p", "first_active_year_gap", "peak_year_gap"))
    return rows.groupBy("macro_topic").agg(
        F.count(F.lit(1)).alias("relation_count"),
        F.count(r).alias("valid_spearman_count"),
        F.count_if(r > 0).alias("spearman_positive_count"),
        F.count_if(r < 0).alias("spearman_negative_count"),
        F.count_if(p < 0.10).alias("spearman_p_lt_10_count"),
        F.count_if(p < 0.05).alias("spearman_p_lt_05_count"),
        F.count_if(first > 0).alias("external_first_count"),
        F.count_if(first == 0).alias("same_first_year_count"),
        F.count_if(peak > 0).alias("external_peak_first_count"),
        F.count_if(peak < 0).alias("corporate_peak_first_count"),
        F.count_if(peak == 0).alias("same_peak_year_count"),
        F.round(F.median(peak), 3).alias("median_peak_year_gap"),
    )


@query(
    f"""WITH {_REVIEW_SQL}, c AS (SELECT macro_topic, count(DISTINCT brand) AS total FROM base WHERE source = 'corporate' GROUP BY ALL), m AS (
  SELECT rv.macro_topic, count(DISTINCT rv.brand) AS matched FROM rv JOIN (SELECT DISTINCT macro_topic, brand FROM base WHERE source = 'corporate') k ON k.macro_topic = rv.macro_topic AND k.brand = rv.brand WHERE paper_status = 'aligned' GROUP BY ALL
), s AS (
  SELECT macro_topic, count(*) FILTER (paper_status = 'aligned') AS aligned, count(*) FILTER (paper_status = 'external_relevant_unpaired') AS unpaired, count(*) FILTER (paper_status = 'excluded') AS excluded,
         count(*) FILTER (paper_status = 'aligned' AND source = 'academic') AS aa, count(*) FILTER (paper_status = 'aligned' AND source = 'media') AS am FROM rv GROUP BY ALL
), r AS (SELECT *, coalesce(matched, 0) / total AS ratio FROM s JOIN c USING (macro_topic) LEFT JOIN m USING (macro_topic))
SELECT macro_topic, aligned AS aligned_external_topic_count, unpaired AS external_relevant_unpaired_count, excluded AS excluded_topic_count, coalesce(matched, 0) AS corporate_groups_matched_aligned, total AS corporate_groups_total, round(ratio, 4) AS corporate_coverage_ratio,
  CASE WHEN ratio >= 0.99 AND unpaired >= 5 THEN 'broad anchor set with substantial external spillovers' WHEN ratio >= 0.99 THEN 'broad coverage with residual external gaps' WHEN ratio >= 0.70 THEN 'partial but substantive coverage' WHEN ratio >= 0.50 THEN 'partial coverage with notable external spillovers' ELSE 'selective coverage concentrated in a few corporate anchors' END AS corporate_coverage_label,
  CASE WHEN ratio >= 0.8 AND unpaired = 0 THEN 'broad corporate coverage' WHEN ratio >= 0.8 AND unpaired >= greatest(3, floor(aligned / 2)) THEN 'broad anchor set with substantial external spillovers' WHEN ratio >= 0.8 THEN 'broad coverage with residual external gaps' WHEN ratio >= 0.5 AND unpaired >= greatest(3, floor(aligned / 2)) THEN 'partial coverage with notable external spillovers' WHEN ratio >= 0.5 THEN 'partial but substantive coverage' ELSE 'selective coverage concentrated in a few corporate anchors' END AS package_coverage_label,
  CASE WHEN aa > 0 AND am > 0 AND aa >= am * 2 THEN 'academic-dominated aligned set with a limited media layer' WHEN aa > 0 AND am > 0 THEN 'mixed academic-media aligned set' WHEN aa > 0 THEN 'academic-only aligned set' WHEN am > 0 THEN 'media-only aligned set' ELSE 'no aligned external set' END AS dominant_alignment_type,
  CASE WHEN unpaired >= 5 AND ratio < 0.99 THEN 'External discourse exceeds what corporate discourse absorbs, indicating a visible blind-spot problem.' WHEN unpaired > 0 THEN 'Corporate discourse covers the core of this domain while leaving some external strands outside its frame.' WHEN ratio >= 0.70 THEN 'Corporate disclosure incorporates most retained external signals in this domain.' ELSE 'Corporate disclosure remains concentrated in a limited subset of possible anchors.' END AS strategic_implication
FROM r"""
)
def macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the corporate groups by aligned topics, with both sets of labels."""
    rows = reviewed(spark, sf_dir)
    groups = chunks(spark, sf_dir).where(F.col("source") == "corporate").select("macro_topic", "brand").distinct()
    total = groups.groupBy("macro_topic").agg(F.count(F.lit(1)).alias("total"))
    is_aligned = F.col("paper_status") == "aligned"
    matched = groups.join(rows.where(is_aligned).select("macro_topic", "brand"), ["macro_topic", "brand"], "left_semi").groupBy("macro_topic").agg(F.count(F.lit(1)).alias("matched"))
    counts = rows.groupBy("macro_topic").agg(F.count_if(is_aligned).alias("aligned"), F.count_if(F.col("paper_status") == "external_relevant_unpaired").alias("unpaired"), F.count_if(F.col("paper_status") == "excluded").alias("excluded"), F.count_if(is_aligned & (F.col("source") == "academic")).alias("aa"), F.count_if(is_aligned & (F.col("source") == "media")).alias("am"))
    out = counts.join(total, "macro_topic").join(matched, "macro_topic", "left").fillna(0, ["matched"]).withColumn("ratio", F.col("matched") / F.col("total"))
    ratio, aligned, unpaired = F.col("ratio"), F.col("aligned"), F.col("unpaired")
    return out.select(
        "macro_topic",
        aligned.alias("aligned_external_topic_count"),
        unpaired.alias("external_relevant_unpaired_count"),
        F.col("excluded").alias("excluded_topic_count"),
        F.col("matched").alias("corporate_groups_matched_aligned"),
        F.col("total").alias("corporate_groups_total"),
        F.round(ratio, 4).alias("corporate_coverage_ratio"),
        numbers.coverage_label(ratio, unpaired).alias("corporate_coverage_label"),
        numbers.package_coverage_label(ratio, aligned, unpaired).alias("package_coverage_label"),
        numbers.alignment_type(F.col("aa"), F.col("am")).alias("dominant_alignment_type"),
        numbers.strategic_implication(ratio, unpaired).alias("strategic_implication"),
    )


@query(
    f"""WITH {BASE_SQL}, st AS (
  SELECT 1 AS stage_order, 'raw_chunks' AS stage, source, count(*) AS n FROM base GROUP BY ALL
  UNION ALL SELECT 2, 'documents', source, count(DISTINCT document_id) FROM base GROUP BY ALL
  UNION ALL SELECT 3, 'documents_since_1997', source, count(DISTINCT document_id) FROM base WHERE year >= 1997 GROUP BY ALL
  UNION ALL SELECT 4, 'documents_large', source, count(DISTINCT document_id) FROM base WHERE year >= 1997 AND size >= 25 GROUP BY ALL
)
SELECT stage_order, stage, CAST(coalesce(max(n) FILTER (source = 'academic'), 0) AS BIGINT) AS academic, CAST(coalesce(max(n) FILTER (source = 'media'), 0) AS BIGINT) AS media, CAST(coalesce(max(n) FILTER (source = 'corporate'), 0) AS BIGINT) AS corporate, CAST(sum(n) AS BIGINT) AS sum_of_sources FROM st GROUP BY ALL"""
)
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after each filter, sources as columns; documents of several sources count in each, so the sum is no total of documents."""
    late, large = F.col("year") >= 1997, F.col("size") >= 25
    per = chunks(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("a"), F.count_distinct("document_id").alias("b"), F.count_distinct(F.when(late, F.col("document_id"))).alias("c"), F.count_distinct(F.when(late & large, F.col("document_id"))).alias("d")
    )
    stages = [(1, "raw_chunks", "a"), (2, "documents", "b"), (3, "documents_since_1997", "c"), (4, "documents_large", "d")]
    rows = per.select("source", F.explode(F.array(*[F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage"), F.col(c).alias("n")) for i, s, c in stages])).alias("s")).select("source", "s.*")
    wide = rows.groupBy("stage_order", "stage").pivot("source", ["academic", "media", "corporate"]).agg(F.max("n")).fillna(0)
    return wide.withColumn("sum_of_sources", F.col("academic") + F.col("media") + F.col("corporate"))


@query(
    f"""WITH {_REVIEW_SQL}, direct AS (SELECT DISTINCT macro_topic, brand FROM rv WHERE decision = 'delete'), cascaded AS (SELECT DISTINCT macro_topic, brand FROM rv WHERE decision = 'not related' AND macro_topic IN ('T1', 'T2')),
x AS (SELECT macro_topic, brand, 'direct' AS reason FROM direct UNION ALL SELECT macro_topic, brand, 'cascaded' FROM cascaded ANTI JOIN direct USING (macro_topic, brand)),
k AS (SELECT DISTINCT source, macro_topic, document_id FROM base ANTI JOIN x USING (macro_topic, brand)), a AS (SELECT source, macro_topic, count(DISTINCT document_id) AS before FROM base GROUP BY ALL)
SELECT source, macro_topic, before AS documents_before, coalesce(n, 0) AS documents_after, before - coalesce(n, 0) AS documents_lost, (SELECT count(*) FROM x WHERE x.macro_topic = a.macro_topic) AS excluded_groups
FROM a LEFT JOIN (SELECT source, macro_topic, count(*) AS n FROM k GROUP BY ALL) USING (source, macro_topic)"""
)
def cascaded_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct exclusions before cascaded ones, and the documents that only excluded groups had."""
    rows, base = reviewed(spark, sf_dir), chunks(spark, sf_dir)
    direct = rows.where(F.col("decision") == "delete").select("macro_topic", "brand").distinct().withColumn("reason", F.lit("direct"))
    cascaded = rows.where((F.col("decision") == "not related") & F.col("macro_topic").isin("T1", "T2")).select("macro_topic", "brand").distinct().withColumn("reason", F.lit("cascaded"))
    gone = by_priority([direct, cascaded], ["macro_topic", "brand"])
    kept = join_bounded(base, gone.select("macro_topic", "brand"), ["macro_topic", "brand"], "left_anti")
    before = base.groupBy("source", "macro_topic").agg(F.count_distinct("document_id").alias("documents_before"))
    after = kept.groupBy("source", "macro_topic").agg(F.count_distinct("document_id").alias("documents_after"))
    groups = gone.groupBy("macro_topic").agg(F.count(F.lit(1)).alias("excluded_groups"))
    out = before.join(after, ["source", "macro_topic"], "left").join(groups, "macro_topic", "left").fillna(0)
    return out.withColumn("documents_lost", F.col("documents_before") - F.col("documents_after"))


@query(
    f"""WITH {_REVIEW_SQL}, g AS (SELECT macro_topic, brand FROM rv WHERE paper_status = 'aligned' AND source <> 'corporate' GROUP BY ALL)
SELECT b.source, b.macro_topic, count(DISTINCT document_id) AS union_documents, CAST(sum(n) OVER (PARTITION BY b.source, b.macro_topic) AS BIGINT) AS summed_documents FROM base b JOIN g USING (macro_topic, brand)
JOIN (SELECT source, macro_topic, CAST(sum(k) AS BIGINT) AS n FROM (SELECT b.source, b.macro_topic, brand, count(DISTINCT document_id) AS k FROM base b JOIN g USING (macro_topic, brand) GROUP BY ALL) GROUP BY ALL) s ON s.source = b.source AND s.macro_topic = b.macro_topic GROUP BY b.source, b.macro_topic, n"""
)
def contributor_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the aligned topics together: as a union, and as a sum that counts shared ones again."""
    wanted = reviewed(spark, sf_dir).where(F.col("paper_status") == "aligned").select("macro_topic", "brand").distinct()
    base = join_bounded(chunks(spark, sf_dir), wanted, ["macro_topic", "brand"], "left_semi")
    union = base.groupBy("source", "macro_topic").agg(F.count_distinct("document_id").alias("union_documents"))
    each = base.groupBy("source", "macro_topic", "brand").agg(F.count_distinct("document_id").alias("k"))
    return union.join(each.groupBy("source", "macro_topic").agg(F.sum("k").alias("summed_documents")), ["source", "macro_topic"])


@query(
    f"""WITH {_REVIEW_SQL} SELECT macro_topic, source, to_json(list_sort(list(DISTINCT brand))) AS brands_json, string_agg(brand, '; ' ORDER BY brand) FILTER (decision <> '') AS decided FROM rv GROUP BY ALL"""
)
def evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct topics as JSON, and those with a decision joined in order."""
    rows = reviewed(spark, sf_dir).withColumn("d", F.when(F.col("decision") != "", F.col("brand")))
    decided = lists.ordered_join(F.col("brand"), F.col("d"), "; ")
    return rows.groupBy("macro_topic", "source").agg(lists.sorted_json(F.col("brand")).alias("brands_json"), F.nullif(decided, F.lit("")).alias("decided"))


@query(
    f"""WITH {_GAP_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY macro_topic ORDER BY abs(peak_year_gap) DESC, brand, external_source) > 1 AS again FROM gaps)
SELECT external_source, macro_topic, brand, peak_year_gap, CAST(row_number() OVER (ORDER BY again, abs(peak_year_gap) DESC, brand, external_source, macro_topic) AS INTEGER) AS position FROM o QUALIFY position <= 20"""
)
def diverse_top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty widest gaps, one of every macro topic first."""
    rows = gaps(spark, sf_dir)
    order = [F.abs("peak_year_gap").desc(), F.col("brand"), F.col("external_source")]
    return diverse_top(rows, "macro_topic", [*order, F.col("macro_topic")], 20).select("external_source", "macro_topic", "brand", "peak_year_gap", "position")


@query(
    """WITH s AS (SELECT doc_id, source AS label, 'stable' AS origin FROM documents), c AS (SELECT doc_id, CASE WHEN toxic = 0 THEN 'relabelled' END AS label, 'changed' AS origin FROM labels)
SELECT * FROM s ANTI JOIN c USING (doc_id) UNION ALL SELECT * FROM c WHERE label IS NOT NULL"""
)
def changed_only_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a later run in place of the stable ones; those without a label drop out."""
    stable = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"), F.lit("stable").alias("origin"))
    changed = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "relabelled").alias("label"), F.lit("changed").alias("origin"))
    return replace_changed(stable, changed, "doc_id")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def resume_open_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH e AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 5 = 0), p AS (SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10)
SELECT * FROM p WHERE vec_id_a NOT IN (SELECT vec_id FROM e) AND vec_id_b NOT IN (SELECT vec_id FROM e)"""
)
def pairs_without_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs neither of whose sides is excluded."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a, b = rows.select(F.col("vec_id").alias("vec_id_a"), "label", (F.col("vec_id") + 10).alias("vec_id_b")), rows.select(F.col("vec_id").alias("vec_id_b"), "label")
    pairs = a.join(b, ["label", "vec_id_b"]).select("vec_id_a", "vec_id_b")
    return without_either(pairs, rows.where(F.col("vec_id") % 5 == 0), "vec_id")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT c_custkey, c_mktsegment, o_orderkey AS best_order, o_totalprice AS best_total FROM customer LEFT JOIN o ON o_custkey = c_custkey AND k = 1"""
)
def best_match_per_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor with its best counterpart, or none."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = first_by(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", F.col("o_orderkey").alias("best_order"), F.col("o_totalprice").alias("best_total"))


@query(f"WITH {BASE_SQL}, c AS (SELECT macro_topic, year, count(DISTINCT document_id) AS n FROM base WHERE source = 'academic' AND year IN (1996, 1998) GROUP BY ALL) SELECT macro_topic, yrs.year, coalesce(n, 0) AS n FROM (SELECT DISTINCT macro_topic FROM c) CROSS JOIN (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1)) AS year) yrs LEFT JOIN c USING (macro_topic, year)")
def zero_filled_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years without any row appear with 0."""
    rows = chunks(spark, sf_dir).where((F.col("source") == "academic") & F.col("year").isin(1996, 1998)).groupBy("macro_topic", "year").agg(F.count_distinct("document_id").alias("n"))
    return series.dense(rows, ["macro_topic"], ["n"])
