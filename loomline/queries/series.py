"""Series, lags and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers, stats, text
from ..operators import matching, relations, series
from ..operators.relational import until_share
from ..plans.corpus import BASE_SQL, DYADS, chunks
from ..storage import stored
from .registry import query

LAGS = [-2, -1, 0, 1, 2]
LEAST = 4
BRAND = ["source", "macro_topic", "brand"]

_PREV_SQL = f"""{BASE_SQL}, yrs AS (
  SELECT unnest(range((SELECT min(year) FROM base), (SELECT max(year) FROM base) + 1)) AS year
), num AS (
  SELECT source, macro_topic, brand, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL
), den AS (
  SELECT source, macro_topic, year, count(DISTINCT document_id) AS d FROM base GROUP BY ALL
), prev AS (
  SELECT source, macro_topic, brand, year, coalesce(n, 0) AS document_count, coalesce(d, 0) AS denominator,
         round(CASE WHEN coalesce(d, 0) = 0 THEN 0.0 ELSE coalesce(n, 0) / d END, 6) AS prevalence
  FROM (SELECT DISTINCT source, macro_topic, brand FROM base) CROSS JOIN yrs
  LEFT JOIN num USING (source, macro_topic, brand, year) LEFT JOIN den USING (source, macro_topic, year)
), dyads(source_a, source_b) AS (VALUES ('media', 'corporate'), ('academic', 'corporate')
), lags(lag) AS (SELECT unnest([-2, -1, 0, 1, 2])
), aligned AS (
  SELECT a.macro_topic, a.brand, source_a, source_b, lag, x.year,
         CASE WHEN x.denominator > 0 THEN x.prevalence END AS x, CASE WHEN y.denominator > 0 THEN y.prevalence END AS y
  FROM (SELECT DISTINCT source, macro_topic, brand FROM base) a
  JOIN dyads ON a.source = source_a
  JOIN (SELECT DISTINCT source, macro_topic, brand FROM base) b ON b.source = source_b AND a.macro_topic = b.macro_topic AND a.brand = b.brand
  CROSS JOIN lags
  JOIN prev x ON x.source = source_a AND x.macro_topic = a.macro_topic AND x.brand = a.brand
  LEFT JOIN prev y ON y.source = source_b AND y.macro_topic = a.macro_topic AND y.brand = a.brand AND y.year = x.year + lag
)"""

_CORR_SQL = f"""{_PREV_SQL}, corrs AS (
  SELECT macro_topic, brand, source_a, source_b, CAST(lag AS INTEGER) AS lag, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_overlap_years,
         CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 4
               AND count(DISTINCT x) FILTER (y IS NOT NULL) > 1 AND count(DISTINCT y) FILTER (x IS NOT NULL) > 1
              THEN round(covar_pop(x, y) / nullif(stddev_pop(x) FILTER (y IS NOT NULL) * stddev_pop(y) FILTER (x IS NOT NULL), 0), 9) END AS correlation
  FROM aligned GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER w AS k, lead(abs(correlation)) OVER w AS next_r, count(*) OVER (PARTITION BY macro_topic, brand, source_a, source_b) AS valid_lags
  FROM corrs WHERE correlation IS NOT NULL
  WINDOW w AS (PARTITION BY macro_topic, brand, source_a, source_b ORDER BY abs(correlation) DESC, n_overlap_years DESC, lag)
), best AS (
  SELECT macro_topic, brand, source_a, source_b, lag AS best_lag, correlation AS best_correlation, n_overlap_years AS best_overlap, valid_lags,
         coalesce(round(abs(correlation) - next_r, 9) < 0.05, false) AS close_second
  FROM ranked WHERE k = 1
)"""

PAIR = ["macro_topic", "brand", "source_a", "source_b"]


def brand_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: a row per brand and year, that several series of a query are made of."""
    return stored(series.prevalence(chunks(spark, sf_dir), BRAND, ["source", "macro_topic"]))


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand series of both sources of each dyad, year against year + lag."""
    values = brand_prevalence(spark, sf_dir).withColumn("value", series.correlation_value())
    out = None
    for a, b in DYADS:
        left = values.where(F.col("source") == a).select("macro_topic", "brand", F.lit(a).alias("source_a"), F.lit(b).alias("source_b"), "year", F.col("value").alias("x"))
        right = values.where(F.col("source") == b).select("macro_topic", "brand", F.lit(a).alias("source_a"), F.lit(b).alias("source_b"), "year", F.col("value").alias("y"))
        left = left.join(right.select("macro_topic", "brand").distinct(), ["macro_topic", "brand"], "left_semi")
        pairs = series.lagged(left, right, PAIR, LAGS)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def pair_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.best_lag(series.lag_correlation(aligned_pairs(spark, sf_dir), PAIR, LEAST), PAIR, "correlation", nearest_zero=False)


@query(
    f"""WITH {BASE_SQL}, yrs AS (SELECT unnest(range((SELECT min(year) FROM base), (SELECT max(year) FROM base) + 1)) AS year)
SELECT t.source, t.macro_topic, t.topic, yrs.year, coalesce(n, 0) AS document_count, coalesce(d, 0) AS annual_source_macro_document_count,
       round(CASE WHEN coalesce(d, 0) = 0 THEN 0.0 ELSE coalesce(n, 0) / d END, 6) AS annual_document_prevalence
FROM (SELECT DISTINCT source, macro_topic, topic FROM base) t CROSS JOIN yrs
LEFT JOIN (SELECT source, macro_topic, topic, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL) USING (source, macro_topic, topic, year)
LEFT JOIN (SELECT source, macro_topic, year, count(DISTINCT document_id) AS d FROM base GROUP BY ALL) USING (source, macro_topic, year)"""
)
def annual_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a source's and macro topic's documents that have a topic, per year, on a dense grid."""
    return series.prevalence(chunks(spark, sf_dir), ["source", "macro_topic", "topic"], ["source", "macro_topic"])


@query(f"WITH {BASE_SQL} SELECT source, macro_topic, year, count(DISTINCT document_id) AS yes_doc_n, count(*) AS yes_chunk_n FROM base GROUP BY ALL")
def source_year_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.annual_counts(chunks(spark, sf_dir), ["source", "macro_topic"], "yes_doc_n", "yes_chunk_n")


@query(
    f"""WITH {BASE_SQL} SELECT source || '_' || macro_topic AS subgroup, source, macro_topic, topic, year,
count(DISTINCT document_id) AS microtopic_doc_n, count(*) AS microtopic_chunk_n FROM base GROUP BY ALL"""
)
def annual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.annual_counts(chunks(spark, sf_dir), ["source", "macro_topic", "topic"], "microtopic_doc_n", "microtopic_chunk_n")
    return rows.withColumn("subgroup", F.concat_ws("_", "source", "macro_topic"))


@query(
    f"""WITH {BASE_SQL}, c AS (
  SELECT source, macro_topic, topic, year, count(DISTINCT document_id) AS n, count(*) AS k FROM base GROUP BY ALL
), d AS (
  SELECT source, macro_topic, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL
), dyads(source_a, source_b) AS (VALUES ('media', 'corporate'), ('academic', 'corporate')
), pairs AS (
  SELECT macro_topic || '__' || topic || '__' || source_a AS pair_id, macro_topic, topic, source_a, source_b
  FROM (SELECT DISTINCT source AS source_a, macro_topic, topic FROM base) JOIN dyads USING (source_a)
  JOIN (SELECT DISTINCT source AS source_b, macro_topic, topic FROM base) USING (source_b, macro_topic, topic)
), yrs AS (
  SELECT DISTINCT pairs.*, year FROM pairs JOIN c ON c.macro_topic = pairs.macro_topic AND c.topic = pairs.topic AND c.source IN (source_a, source_b)
)
SELECT pair_id, p.macro_topic, source_a, p.topic AS topic_a, source_b, p.topic AS topic_b, p.year,
       CASE WHEN da.n IS NOT NULL THEN coalesce(ca.n, 0) END AS documents_a, CASE WHEN da.n IS NOT NULL THEN coalesce(ca.k, 0) END AS chunks_a, da.n AS denominator_a,
       round(CASE WHEN da.n > 0 THEN coalesce(ca.n, 0) / da.n END, 6) AS share_a,
       CASE WHEN db.n IS NOT NULL THEN coalesce(cb.n, 0) END AS documents_b, CASE WHEN db.n IS NOT NULL THEN coalesce(cb.k, 0) END AS chunks_b, db.n AS denominator_b,
       round(CASE WHEN db.n > 0 THEN coalesce(cb.n, 0) / db.n END, 6) AS share_b
FROM yrs p
LEFT JOIN c ca ON ca.source = source_a AND ca.macro_topic = p.macro_topic AND ca.topic = p.topic AND ca.year = p.year
LEFT JOIN c cb ON cb.source = source_b AND cb.macro_topic = p.macro_topic AND cb.topic = p.topic AND cb.year = p.year
LEFT JOIN d da ON da.source = source_a AND da.macro_topic = p.macro_topic AND da.year = p.year
LEFT JOIN d db ON db.source = source_b AND db.macro_topic = p.macro_topic AND db.year = p.year"""
)
def pair_annual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source", "macro_topic", "topic"]
    cells = series.document_cells(stored(chunks(spark, sf_dir).select(*keys, "year", "document_id")), keys, keys[:2])
    topics = cells.select(*keys).distinct()
    pairs = None
    for a, b in DYADS:
        left = topics.where(F.col("source") == a).select("macro_topic", "topic")
        both = left.join(topics.where(F.col("source") == b).select("macro_topic", "topic"), ["macro_topic", "topic"])
        both = both.select(F.concat_ws("__", "macro_topic", "topic", F.lit(a)).alias("pair_id"), "macro_topic", F.lit(a).alias("source_a"), F.col("topic").alias("topic_a"), F.lit(b).alias("source_b"), F.col("topic").alias("topic_b"))
        pairs = both if pairs is None else pairs.unionByName(both)
    counts = cells.select(*keys, "year", F.col("d").alias("document_count"), F.col("f").alias("chunk_count"))
    totals = cells.groupBy(*keys[:2], "year").agg(F.sum("d_year").alias("document_count"), F.sum("f").alias("chunk_count"))
    return series.pair_series(pairs, counts, totals)


@query(
    f"""WITH {_PREV_SQL}, active AS (SELECT *, row_number() OVER (PARTITION BY source, macro_topic, brand ORDER BY prevalence DESC, document_count DESC, year) AS k FROM prev WHERE document_count > 0)
SELECT source, macro_topic, brand, min(year) AS first_active_year, max(year) FILTER (k = 1) AS peak_year, count(*) AS active_year_count,
       CAST(sum(document_count) AS BIGINT) AS total_document_count, max(prevalence) FILTER (k = 1) AS peak_prevalence
FROM active GROUP BY ALL"""
)
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_stats(brand_prevalence(spark, sf_dir), BRAND)


_GAP_SQL = f"""{_PREV_SQL}, active AS (
  SELECT *, row_number() OVER (PARTITION BY source, macro_topic, brand ORDER BY prevalence DESC, document_count DESC, year) AS k FROM prev WHERE document_count > 0
), st AS (
  SELECT source, macro_topic, brand, min(year) AS first_year, max(year) FILTER (k = 1) AS peak_year FROM active GROUP BY ALL
), gaps AS (
  SELECT e.source AS external_source, e.macro_topic, e.brand, c.first_year - e.first_year AS first_active_year_gap, c.peak_year - e.peak_year AS peak_year_gap, c.peak_year AS corporate_peak_year, e.peak_year AS external_peak_year
  FROM st e JOIN st c USING (macro_topic, brand) WHERE e.source <> 'corporate' AND c.source = 'corporate'
)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-year and peak-year gaps, corporate minus external."""
    facts = series.series_stats(brand_prevalence(spark, sf_dir), BRAND)
    own = facts.where(F.col("source") == "corporate").select("macro_topic", "brand", F.col("first_active_year").alias("_f"), F.col("peak_year").alias("corporate_peak_year"))
    rows = facts.where(F.col("source") != "corporate").join(own, ["macro_topic", "brand"])
    return rows.select(F.col("source").alias("external_source"), "macro_topic", "brand", (F.col("_f") - F.col("first_active_year")).alias("first_active_year_gap"), (F.col("corporate_peak_year") - F.col("peak_year")).alias("peak_year_gap"), "corporate_peak_year", F.col("peak_year").alias("external_peak_year"))


@query(
    f"""WITH {_GAP_SQL} SELECT *, CASE WHEN peak_year_gap > 0 THEN 'external_peaks_before_corporate' WHEN peak_year_gap < 0 THEN 'corporate_peaks_before_external' ELSE 'synchronous_peak' END AS peak_label,
CASE WHEN abs(peak_year_gap) <= 1 THEN 'near_synchronous_peak_abs_le_1_year' WHEN peak_year_gap >= 2 THEN 'external_peaks_before_corporate_2plus_years' ELSE 'corporate_peaks_before_external_2plus_years' END AS peak_window,
CASE WHEN first_active_year_gap > 0 THEN 'external_active_before_corporate' WHEN first_active_year_gap < 0 THEN 'corporate_active_before_external' ELSE 'same_first_active_year' END AS onset_label FROM gaps"""
)
def gap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps(spark, sf_dir)
    return rows.select("*", numbers.peak_label(F.col("peak_year_gap")).alias("peak_label"), numbers.peak_window_label(F.col("peak_year_gap")).alias("peak_window"), numbers.onset_label(F.col("first_active_year_gap")).alias("onset_label"))


_INDEX_SQL = """, r AS (
  SELECT *, CASE WHEN prevalence > 0 THEN count(*) FILTER (prevalence > 0) OVER (PARTITION BY source, macro_topic, brand ORDER BY year ROWS UNBOUNDED PRECEDING) END AS k FROM prev
), b AS (
  SELECT source, macro_topic, brand, min(year) FILTER (prevalence > 0) AS base_year, avg(prevalence) FILTER (k <= {n}) AS base_value FROM r GROUP BY ALL
)
SELECT source, macro_topic, brand, year, base_year, CASE WHEN year >= base_year THEN round(prevalence / base_value * 100, 6) END AS index_value FROM r JOIN b USING (source, macro_topic, brand)"""


@query(f"WITH {_PREV_SQL}" + _INDEX_SQL.format(n=1))
def indexed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.indexed(brand_prevalence(spark, sf_dir), BRAND, "annual_document_prevalence").select(*BRAND, "year", "base_year", "index_value")


@query(f"WITH {_PREV_SQL}" + _INDEX_SQL.format(n=3))
def indexed_share_avg_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.indexed(brand_prevalence(spark, sf_dir), BRAND, "annual_document_prevalence", 3).select(*BRAND, "year", "base_year", "index_value")


@query(f"WITH {_CORR_SQL} SELECT macro_topic, brand, source_a, source_b, lag, n_overlap_years, correlation FROM corrs")
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lag_correlation(aligned_pairs(spark, sf_dir), PAIR, LEAST)


@query(f"WITH {_CORR_SQL} SELECT macro_topic, brand, source_a, source_b, best_lag, best_correlation, best_overlap, valid_lags, close_second, valid_lags < 3 OR close_second AS unstable_series_flag FROM best")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_best(spark, sf_dir)
    return rows.withColumn("unstable_series_flag", relations.unstable(F.col("valid_lags"), F.col("close_second")))


_CLASS_SQL = f"""{_CORR_SQL}, classed AS (
  SELECT *, CASE WHEN valid_lags < 3 OR close_second OR abs(best_correlation) < 0.30 THEN 'synchronous_or_unclear' WHEN best_lag > 0 THEN 'source_a_leads' WHEN best_lag < 0 THEN 'source_b_leads' ELSE 'synchronous_or_unclear' END AS precedence_class,
         CASE WHEN valid_lags < 3 OR close_second OR abs(best_correlation) < 0.30 THEN 'low_information_or_unclear' WHEN best_lag > 0 THEN 'positive_best_lag_docs' WHEN best_lag < 0 THEN 'negative_best_lag_docs' ELSE 'zero_best_lag_docs' END AS precedence_reason
  FROM best
)"""


@query(f"WITH {_CLASS_SQL} SELECT macro_topic, brand, source_a, source_b, best_lag, precedence_class, precedence_reason FROM classed")
def precedence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.precedence(pair_best(spark, sf_dir)).select(*PAIR, "best_lag", "precedence_class", "precedence_reason")


@query(
    f"""WITH {_CLASS_SQL} SELECT macro_topic, source_a, count(DISTINCT brand) AS pair_count, round(avg(best_correlation), 6) AS mean_best_correlation, round(median(best_correlation), 6) AS median_best_correlation,
round(avg(abs(best_lag)), 6) AS mean_abs_best_lag, count(*) FILTER (best_lag = 0) AS zero_lag_count, count(*) FILTER (precedence_class = 'synchronous_or_unclear') AS synchronous_or_unclear_count,
round(count(DISTINCT brand) / (SELECT count(*) FROM classed), 6) AS share_of_pairs FROM classed GROUP BY ALL"""
)
def precedence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.precedence(pair_best(spark, sf_dir)).withColumn("pair_id", F.concat_ws("__", *PAIR))
    return relations.precedence_summary(rows, ["macro_topic", "source_a"], "pair_id")


@query(
    f"""WITH {_CORR_SQL} SELECT macro_topic, brand, source_a, source_b, best_lag,
CASE WHEN valid_lags < 3 OR close_second THEN 'unstable_series' WHEN best_correlation < 0.30 THEN 'correlation_below_floor' WHEN best_lag > 0 THEN 'positive_best_lag_docs' WHEN best_lag < 0 THEN 'negative_best_lag_docs' ELSE 'zero_best_lag_docs' END AS temporal_reason,
CASE WHEN valid_lags < 3 OR close_second OR best_correlation < 0.30 THEN 'indeterminate' WHEN best_lag > 0 THEN 'A_precedes_B' WHEN best_lag < 0 THEN 'B_precedes_A' ELSE 'synchronous' END AS temporal_group FROM best"""
)
def temporal_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.temporal_group(pair_best(spark, sf_dir)).select(*PAIR, "best_lag", "temporal_reason", "temporal_group")


_T_SQL = """CASE n_overlap_years - 2
    WHEN 2 THEN 1 - sin(th) WHEN 3 THEN 1 - 2 / pi() * (th + sin(th) * cos(th))
    WHEN 4 THEN 1 - sin(th) * (1 + cos(th) * cos(th) / 2) WHEN 5 THEN 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2 * cos(th) ** 3 / 3)) END"""
_SPEAR_SQL = f"""{_PREV_SQL}, both_sides AS (SELECT * FROM aligned WHERE x IS NOT NULL AND y IS NOT NULL), rk AS (
  SELECT *, rank() OVER (PARTITION BY macro_topic, brand, source_a, source_b, lag ORDER BY x) + (count(*) OVER (PARTITION BY macro_topic, brand, source_a, source_b, lag, x) - 1) / 2 AS rx,
         rank() OVER (PARTITION BY macro_topic, brand, source_a, source_b, lag ORDER BY y) + (count(*) OVER (PARTITION BY macro_topic, brand, source_a, source_b, lag, y) - 1) / 2 AS ry
  FROM both_sides
), sp AS (
  SELECT macro_topic, brand, source_a, source_b, CAST(lag AS INTEGER) AS lag, count(*) AS n_overlap_years,
         CASE WHEN count(*) >= 4 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) END AS spearman_r
  FROM rk GROUP BY ALL
), pv AS (
  SELECT *, greatest(0, {_T_SQL}) AS spearman_p FROM (SELECT *, atan2(abs(spearman_r), sqrt(greatest(0, 1 - spearman_r * spearman_r))) AS th FROM sp)
), q AS (
  SELECT *, round(spearman_p, 9) AS p9 FROM pv
), raw AS (
  SELECT *, p9 * count(p9) OVER (PARTITION BY macro_topic, brand, source_a, source_b) / row_number() OVER (PARTITION BY macro_topic, brand, source_a, source_b ORDER BY p9 NULLS LAST, lag) AS raw_rel,
         p9 * (SELECT count(p9) FROM q) / row_number() OVER (ORDER BY p9 NULLS LAST, macro_topic, brand, source_a, source_b, lag) AS raw_tab FROM q
), adj AS (
  SELECT *, CASE WHEN p9 IS NOT NULL THEN least(1.0, min(raw_rel) OVER (PARTITION BY macro_topic, brand, source_a, source_b ORDER BY p9 DESC NULLS FIRST, lag DESC ROWS UNBOUNDED PRECEDING)) END AS q_relation,
         CASE WHEN p9 IS NOT NULL THEN least(1.0, min(raw_tab) OVER (ORDER BY p9 DESC NULLS FIRST, macro_topic DESC, brand DESC, source_a DESC, source_b DESC, lag DESC ROWS UNBOUNDED PRECEDING)) END AS q_table FROM raw
)"""


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.rank_correlation(aligned_pairs(spark, sf_dir), PAIR, LEAST)
    return rows.withColumn("spearman_p", F.round(stats.t_two_sided_p(F.col("spearman_r"), F.col("n_overlap_years")), 9))


@query(f"WITH {_SPEAR_SQL} SELECT macro_topic, brand, source_a, source_b, lag, n_overlap_years, spearman_r, p9 AS spearman_p FROM q")
def spearman_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(spark, sf_dir).select(*PAIR, "lag", "n_overlap_years", "spearman_r", "spearman_p")


def with_q(rows: DataFrame) -> DataFrame:
    """Both kinds of q-values; the correlations, which they read several times, are written once."""
    rows = stored(rows)
    within = stats.bh_within(rows, "spearman_p", "q_relation", PAIR, ["lag"])
    return stats.bh_table(within, "spearman_p", "q_table", [*PAIR, "lag"])


@query(f"WITH {_SPEAR_SQL} SELECT macro_topic, brand, source_a, source_b, lag, round(q_relation, 6) AS spearman_q_relation, round(q_table, 6) AS spearman_q_table FROM adj")
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_q(spearman(spark, sf_dir)).select(*PAIR, "lag", F.round("q_relation", 6).alias("spearman_q_relation"), F.round("q_table", 6).alias("spearman_q_table"))


_REL_SQL = f"""{_SPEAR_SQL}, ranked_s AS (
  SELECT *, row_number() OVER w AS k, lead(abs(spearman_r)) OVER w AS next_r FROM adj WHERE spearman_r IS NOT NULL
  WINDOW w AS (PARTITION BY macro_topic, brand, source_a, source_b ORDER BY abs(spearman_r) DESC, n_overlap_years DESC, abs(lag), lag DESC)
), rel AS (
  SELECT *, coalesce(round(abs(spearman_r) - next_r, 9) < 0.05, false) AS ambiguous FROM ranked_s WHERE k = 1
)"""


@query(
    f"""WITH {_REL_SQL} SELECT macro_topic, brand, source_a, source_b, lag AS best_lag, spearman_r AS best_spearman_r, round(q_table, 6) AS best_spearman_q_table, ambiguous AS ambiguous_best_lag_flag,
CASE WHEN abs(spearman_r) < 0.30 OR lag = 0 THEN 'synchronous_or_unclear' WHEN lag > 0 THEN 'external_leads' ELSE 'corporate_leads' END AS temporal_relation_label,
CASE WHEN abs(spearman_r) < 0.30 THEN 'correlation_below_floor' WHEN lag > 0 THEN 'positive_best_lag_external_leads' || CASE WHEN ambiguous THEN '_ambiguous' ELSE '' END WHEN lag < 0 THEN 'negative_best_lag_corporate_leads' || CASE WHEN ambiguous THEN '_ambiguous' ELSE '' END ELSE 'zero_best_lag' END AS temporal_relation_reason FROM rel"""
)
def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(with_q(spearman(spark, sf_dir)))
    best = relations.relation_label(series.best_lag(rows, PAIR, "spearman_r", nearest_zero=True))
    q = rows.select(*PAIR, F.col("lag").alias("best_lag"), F.round("q_table", 6).alias("best_spearman_q_table"))
    return best.join(q, [*PAIR, "best_lag"]).select(*PAIR, "best_lag", F.col("best_correlation").alias("best_spearman_r"), "best_spearman_q_table", F.col("close_second").alias("ambiguous_best_lag_flag"), "temporal_relation_label", "temporal_relation_reason")


@query(
    f"""WITH {_SPEAR_SQL} SELECT macro_topic, brand, source_a, spearman_r AS same_year_spearman_r, round(q_table, 6) AS same_year_spearman_q_table,
CASE WHEN spearman_r IS NULL THEN 'not_available' WHEN spearman_r > 0 THEN 'same_direction' WHEN spearman_r < 0 THEN 'opposite_direction' ELSE 'no_monotonic_association' END AS same_year_relation_direction,
CASE WHEN spearman_r IS NULL THEN 'not_available' WHEN abs(spearman_r) >= 0.70 THEN 'strong' WHEN abs(spearman_r) >= 0.50 THEN 'moderate' WHEN abs(spearman_r) >= 0.30 THEN 'weak' ELSE 'very_weak' END AS same_year_relation_strength,
CASE WHEN q_table < 0.05 THEN 'q_lt_0_05' WHEN q_table < 0.10 THEN 'q_lt_0_10' ELSE 'not_significant' END AS same_year_significance FROM adj WHERE lag = 0"""
)
def zero_lag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_q(spearman(spark, sf_dir)).where("lag = 0")
    r, q = F.col("spearman_r"), F.col("q_table")
    return rows.select("macro_topic", "brand", "source_a", r.alias("same_year_spearman_r"), F.round(q, 6).alias("same_year_spearman_q_table"), numbers.relation_direction(r).alias("same_year_relation_direction"), numbers.relation_strength(r).alias("same_year_relation_strength"), numbers.significance(q).alias("same_year_significance"))


_LEAD_SQL = """, pairs_ab(source_from, source_to) AS (
  VALUES ('academic', 'corporate'), ('academic', 'media'), ('corporate', 'academic'), ('corporate', 'media'), ('media', 'academic'), ('media', 'corporate')
), al AS (
  SELECT {w} x.macro_topic, source_from, source_to, CAST(lag AS INTEGER) AS lag, x.method, x.v AS xv, y.v AS yv
  FROM vals x JOIN pairs_ab ON x.source = source_from CROSS JOIN lags
  LEFT JOIN vals y ON y.source = source_to AND y.macro_topic = x.macro_topic AND y.method = x.method {j} AND y.year = x.year + lag
), cs AS (
  SELECT {g} macro_topic, source_from, source_to, method AS transform_method, lag, count(*) FILTER (xv IS NOT NULL AND yv IS NOT NULL) AS n_overlap_years,
         CASE WHEN count(*) FILTER (xv IS NOT NULL AND yv IS NOT NULL) >= {least} AND count(DISTINCT xv) FILTER (yv IS NOT NULL) > 1 AND count(DISTINCT yv) FILTER (xv IS NOT NULL) > 1
              THEN round(covar_pop(xv, yv) / nullif(stddev_pop(xv) FILTER (yv IS NOT NULL) * stddev_pop(yv) FILTER (xv IS NOT NULL), 0), 9) END AS correlation
  FROM al GROUP BY ALL
)"""
_SHARE_SQL = f"""{BASE_SQL}, lags(lag) AS (SELECT unnest([-2, -1, 0, 1, 2])), sh AS (
  SELECT source, macro_topic, year, round(n / d, 9) AS v
  FROM (SELECT source, macro_topic, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL) JOIN (SELECT source, year, count(DISTINCT document_id) AS d FROM base GROUP BY ALL) USING (source, year)
)"""


def topic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = chunks(spark, sf_dir)
    n = series.annual_counts(base, ["source", "macro_topic"]).drop("chunk_count")
    d = series.annual_counts(base, ["source"], "d", "_c").drop("_c")
    return n.join(d, ["source", "year"]).select("source", "macro_topic", "year", F.round(F.col("document_count") / F.col("d"), 9).alias("v"))


def lead_lag(values: DataFrame, extra: list[str], least: int) -> DataFrame:
    """Correlations of the transforms of every ordered pair of sources, per lag."""
    melted = values.select(*extra, "source", "macro_topic", "year", F.explode(F.array(F.struct(F.lit("difference").alias("m"), F.round("difference", 9).alias("v")), F.struct(F.lit("residual").alias("m"), F.round("residual", 9).alias("v")))).alias("t"))
    melted = melted.select(*extra, "source", "macro_topic", "year", F.col("t.m").alias("transform_method"), F.col("t.v").alias("v"))
    sources = ["academic", "corporate", "media"]
    others = F.filter(F.array(*map(F.lit, sources)), lambda s: s != F.col("source"))
    left = melted.withColumnRenamed("v", "x").withColumn("source_to", F.explode(others)).withColumnRenamed("source", "source_from")
    right = melted.withColumnRenamed("v", "y").withColumn("source_from", F.explode(others)).withColumnRenamed("source", "source_to")
    keys = [*extra, "macro_topic", "source_from", "source_to", "transform_method"]
    return series.lag_correlation(series.lagged(left, right, keys, LAGS), keys, least)


@query(
    f"""WITH {_SHARE_SQL}, tr AS (
  SELECT *, round(v - lag(v) OVER (PARTITION BY source, macro_topic ORDER BY year), 9) AS difference,
         round(v - (avg(v) OVER w + coalesce(regr_slope(v, year) OVER w, 0) * (year - avg(year) OVER w)), 9) AS residual FROM sh WINDOW w AS (PARTITION BY source, macro_topic)
), vals AS (
  SELECT source, macro_topic, year, 'difference' AS method, difference AS v FROM tr UNION ALL SELECT source, macro_topic, year, 'residual', residual FROM tr
)""" + _LEAD_SQL.format(w="", j="", g="", least=3) + " SELECT * FROM cs"
)
def detrended_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead_lag(series.with_transforms(topic_shares(spark, sf_dir), ["source", "macro_topic"], "v"), [], 3)


@query(
    f"""WITH {_SHARE_SQL}, ws AS (
  SELECT unnest(range((SELECT min(year) FROM sh), (SELECT max(year) FROM sh) - 3)) AS window_start
), inw AS (
  SELECT sh.*, window_start FROM sh JOIN ws ON year BETWEEN window_start AND window_start + 4
), tr AS (
  SELECT *, round(v - lag(v) OVER (PARTITION BY window_start, source, macro_topic ORDER BY year), 9) AS difference,
         round(v - (avg(v) OVER w + coalesce(regr_slope(v, year) OVER w, 0) * (year - avg(year) OVER w)), 9) AS residual FROM inw WINDOW w AS (PARTITION BY window_start, source, macro_topic)
), vals AS (
  SELECT window_start, source, macro_topic, year, 'difference' AS method, difference AS v FROM tr UNION ALL SELECT window_start, source, macro_topic, year, 'residual', residual FROM tr
)""" + _LEAD_SQL.format(w="x.window_start,", j="AND y.window_start = x.window_start", g="window_start,", least=4) + " SELECT * FROM cs"
)
def rolling_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transforms are made inside each window of five years."""
    inside = series.windows(topic_shares(spark, sf_dir), 5)
    return lead_lag(series.with_transforms(inside, ["window_start", "source", "macro_topic"], "v"), ["window_start"], 4)


@query(
    f"""WITH {BASE_SQL}, a AS (SELECT source, macro_topic, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL), b AS (SELECT source, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL),
c AS (SELECT macro_topic, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL), d AS (SELECT year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL)
SELECT source, macro_topic, year, a.n AS document_count, round(a.n / b.n, 6) AS rate_of_source, round(a.n / c.n, 6) AS rate_of_topic, round(a.n / d.n, 6) AS rate_of_all
FROM a JOIN b USING (source, year) JOIN c USING (macro_topic, year) JOIN d USING (year)"""
)
def presence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = chunks(spark, sf_dir)
    count = lambda keys, name: series.annual_counts(base, keys, name, "_c").drop("_c")
    out = count(["source", "macro_topic"], "document_count").join(count(["source"], "b"), ["source", "year"]).join(count(["macro_topic"], "c"), ["macro_topic", "year"]).join(count([], "d"), "year")
    rate = lambda c: F.round(F.col("document_count") / F.col(c), 6)
    return out.select("source", "macro_topic", "year", "document_count", rate("b").alias("rate_of_source"), rate("c").alias("rate_of_topic"), rate("d").alias("rate_of_all"))


@query(f"WITH {BASE_SQL} SELECT source, macro_topic, year, round(avg(k), 6) AS mean_chunks, CAST(max(k) AS BIGINT) AS max_chunks FROM (SELECT source, macro_topic, year, document_id, count(*) AS k FROM base GROUP BY ALL) GROUP BY ALL")
def topic_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per document of a topic and year, then their mean."""
    per = chunks(spark, sf_dir).groupBy("source", "macro_topic", "year", "document_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("source", "macro_topic", "year").agg(F.round(F.avg("k"), 6).alias("mean_chunks"), F.max("k").alias("max_chunks"))


def _rule_sql(name: str, years: int, shared: int, documents: int, chunk_n: int) -> str:
    tests = [(f"ya < {years}", "source_a_active_years"), (f"yb < {years}", "source_b_active_years"), (f"o < {shared}", "overlap_years"), (f"da < {documents}", "source_a_docs"), (f"db < {documents}", "source_b_docs"), (f"ka < {chunk_n}", "source_a_chunks"), (f"kb < {chunk_n}", "source_b_chunks")]
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {t} THEN '{r}_below_threshold' END" for t, r in tests) + f") AS {name}_exclusion_reasons"


@query(
    f"""WITH {BASE_SQL}, p AS (
  SELECT source, macro_topic, topic, count(DISTINCT document_id) AS d, count(*) AS k, list(DISTINCT year) AS y FROM base GROUP BY ALL
), j AS (
  SELECT a.source AS source_a, macro_topic, topic, a.d AS da, b.d AS db, a.k AS ka, b.k AS kb, len(a.y) AS ya, len(b.y) AS yb, CAST(len(list_intersect(a.y, b.y)) AS INTEGER) AS o
  FROM p a JOIN p b USING (macro_topic, topic) WHERE a.source <> 'corporate' AND b.source = 'corporate'
)
SELECT source_a, macro_topic, topic, o AS overlap_year_count, {", ".join(_rule_sql(k, *v) for k, v in matching.TEMPORAL_RULES.items())} FROM j"""
)
def temporal_viability(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = matching.profiles(chunks(spark, sf_dir), ["source", "macro_topic", "topic"])
    sides = [facts.select("macro_topic", "topic", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "document_count", "chunk_count", "years")]) for s in ("a", "b")]
    pairs = sides[0].where(F.col("source_a") != "corporate").join(sides[1].where(F.col("source_b") == "corporate"), ["macro_topic", "topic"])
    return matching.temporal_viability(pairs).select("source_a", "macro_topic", "topic", "overlap_year_count", *[f"{r}_exclusion_reasons" for r in matching.TEMPORAL_RULES])


@query(
    f"""WITH {BASE_SQL}, c AS (SELECT source, macro_topic, brand, count(DISTINCT document_id) AS n FROM base GROUP BY ALL), r AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(n) OVER (PARTITION BY source, macro_topic ORDER BY n DESC, brand ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY source, macro_topic), 9) AS cumulative_share FROM c WINDOW w AS (PARTITION BY source, macro_topic ORDER BY n DESC, brand)
), b AS (SELECT *, coalesce(lag(cumulative_share) OVER (PARTITION BY source, macro_topic ORDER BY rank), 0) AS before FROM r)
SELECT source, macro_topic, brand, n, rank, cumulative_share FROM b WHERE (before < 0.75 AND rank <= 10) OR rank <= 1"""
)
def coverage_topk_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest topics of a subgroup up to three quarters of its documents, between one and ten."""
    counts = chunks(spark, sf_dir).groupBy("source", "macro_topic", "brand").agg(F.count_distinct("document_id").alias("n"))
    return until_share(counts, ["source", "macro_topic"], "n", 0.75, 1, 10, "brand")


@query(
    f"""WITH {BASE_SQL}, c AS (SELECT source, macro_topic, topic, count(*) AS n FROM base GROUP BY ALL), s AS (
  SELECT *, n / sum(n) OVER (PARTITION BY source, macro_topic) AS p, row_number() OVER (PARTITION BY source, macro_topic ORDER BY n, topic) AS i FROM c
)
SELECT source, macro_topic, count(*) AS n_topics, round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS effective_topics, round(sum(p * p), 6) AS hhi,
       round(sum(2 * i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, round(quantile_cont(n, 0.9), 6) AS p90 FROM s GROUP BY ALL"""
)
def topic_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = chunks(spark, sf_dir).groupBy("source", "macro_topic", "topic").agg(F.count(F.lit(1)).alias("n"))
    return stats.concentration(counts, ["source", "macro_topic"], "n", "topic")


@query(
    f"""WITH {_GAP_SQL}, e AS (SELECT * FROM prev WHERE source <> 'corporate'), c AS (SELECT * FROM prev WHERE source = 'corporate'), f AS (SELECT macro_topic, brand, min(year) AS first_year FROM c WHERE document_count > 0 GROUP BY ALL),
m AS (
  SELECT e.source AS external_source, macro_topic, brand, first_year, coalesce(round(sum(e.prevalence) FILTER (e.year - first_year BETWEEN -3 AND -1), 6), 0.0) AS prior_sum
  FROM e JOIN f USING (macro_topic, brand) GROUP BY ALL
), o AS (
  SELECT macro_topic, brand, max(prevalence) FILTER (year = first_year) AS onset, max(prevalence) FILTER (year - first_year BETWEEN 1 AND 3) AS later FROM c JOIN f USING (macro_topic, brand) GROUP BY ALL
)
SELECT external_source, macro_topic, brand, first_year, prior_sum, onset AS onset_prevalence, round(later - onset, 6) AS later_growth,
  CASE WHEN later - onset IS NULL THEN 'insufficient_later_growth_window' WHEN prior_sum > 0 AND round(later - onset, 6) > 0 THEN 'external_prior_exposure_with_later_corporate_growth' WHEN prior_sum > 0 THEN 'external_prior_exposure_without_later_corporate_growth'
       WHEN round(later - onset, 6) > 0 THEN 'corporate_growth_without_prior_external_exposure' ELSE 'no_prior_external_exposure_no_later_corporate_growth' END AS pattern
FROM m JOIN o USING (macro_topic, brand)"""
)
def exposure_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = brand_prevalence(spark, sf_dir)
    corporate, out = values.where(F.col("source") == "corporate"), None
    for s in ("academic", "media"):
        rows = series.exposure_growth(values.where(F.col("source") == s), corporate, ["macro_topic", "brand"]).withColumn("external_source", F.lit(s))
        rows = rows.join(values.where(F.col("source") == s).select("macro_topic", "brand").distinct(), ["macro_topic", "brand"], "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out.select("external_source", "macro_topic", "brand", "first_year", "prior_sum", "onset_prevalence", "later_growth", numbers.exposure_pattern(F.col("prior_sum"), F.col("later_growth")).alias("pattern"))


_BINOM_SQL = """round(CASE WHEN n = 0 THEN NULL ELSE least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, n + 1) t(i)
  WHERE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) <= exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * (1 + 1e-7))) END, 6)"""


@query(
    f"""WITH {_GAP_SQL}, s AS (
  SELECT coalesce(external_source, 'all') AS comparison_set, count(*) AS valid_peak_rows, count(*) FILTER (peak_year_gap > 0) AS k, count(*) FILTER (peak_year_gap <> 0) AS n, count(*) FILTER (peak_year_gap = 0) AS synchronous_peak
  FROM gaps GROUP BY ROLLUP (external_source)
), e AS (
  SELECT comparison_set, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2) AS lp, k FROM s, LATERAL (SELECT unnest(range(0, n + 1)) AS i)
)
SELECT s.comparison_set, valid_peak_rows, s.k AS external_peaks_before_corporate, n - s.k AS corporate_peaks_before_external, synchronous_peak, round(s.k / n, 6) AS strict_external_share,
       round(least(1.0, sum(exp(lp)) FILTER (lp <= own + 1e-7)), 6) AS p_two_sided, round(least(1.0, sum(exp(lp)) FILTER (i >= s.k)), 6) AS p_external_more_frequent
FROM s JOIN e USING (comparison_set) JOIN (SELECT comparison_set, lp AS own FROM e WHERE i = k) USING (comparison_set) GROUP BY ALL"""
)
def peak_precedence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations and each source's, with exact binomial tests of whose peak comes first."""
    gap = F.col("peak_year_gap")
    rows = gaps(spark, sf_dir).rollup("external_source").agg(F.count(F.lit(1)).alias("valid_peak_rows"), F.count_if(gap > 0).alias("k"), F.count_if(gap != 0).alias("n"), F.count_if(gap == 0).alias("synchronous_peak"))
    p = lambda kind: F.round(stats.binomial_p(F.col("k"), F.col("n"), kind), 6)
    return rows.select(F.coalesce("external_source", F.lit("all")).alias("comparison_set"), "valid_peak_rows", F.col("k").alias("external_peaks_before_corporate"), (F.col("n") - F.col("k")).alias("corporate_peaks_before_external"), "synchronous_peak", F.round(numbers.safe_ratio(F.col("k"), F.col("n")), 6).alias("strict_external_share"), p("two-sided").alias("p_two_sided"), p("greater").alias("p_external_more_frequent"))


@query(f"WITH {BASE_SQL} SELECT macro_topic, source, n, round(n / sum(n) OVER (PARTITION BY macro_topic), 6) AS share_within_topic, 'lag ' || CASE WHEN n % 7 - 3 >= 0 THEN '+' ELSE '' END || CAST(n % 7 - 3 AS VARCHAR) AS lag_text FROM (SELECT macro_topic, source, count(DISTINCT document_id) AS n FROM base GROUP BY ALL)")
def share_within_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).groupBy("macro_topic", "source").agg(F.count_distinct("document_id").alias("n"))
    return rows.select("macro_topic", "source", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("macro_topic")), 6).alias("share_within_topic"), text.format_lag(F.col("n") % 7 - 3).alias("lag_text"))
