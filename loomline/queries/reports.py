"""Tables behind a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations, reports, series
from ..operators.relational import top_by
from ..plans.corpus import BASE_SQL, chunks
from .narratives import _BRAND_SQL, told
from .registry import query
from .review import _REVIEW_SQL, reviewed
from .series import _CLASS_SQL, BRAND, pair_annual_series, pair_best

_EVOLVED_SQL = f"""{BASE_SQL}, {_BRAND_SQL}, yc AS (SELECT source, macro_topic, brand, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL
), yj AS (SELECT source, macro_topic, brand, to_json(list({{'year': year, 'documents': n}} ORDER BY year)) AS annual_counts_json, CAST(sum(n) AS BIGINT) AS document_years, arg_max(year, (n, -year)) AS peak FROM yc GROUP BY ALL
), dp AS (SELECT source, macro_topic, brand, count(*) FILTER (years <> '') AS dated_phases FROM narr_w GROUP BY ALL
), ev AS (SELECT source, macro_topic, brand, ready AS is_narrative_ready, evolution_pattern, dated_phases, compact AS phases_compact, document_years, peak AS peak_year, annual_counts_json FROM narr JOIN yj USING (source, macro_topic, brand) JOIN dp USING (source, macro_topic, brand))"""


def _evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = series.annual_counts(chunks(spark, sf_dir), BRAND, "document_count", "_c").drop("_c")
    return reports.evolution(told(spark, sf_dir, BRAND), counts, BRAND)


@query(f"WITH {_EVOLVED_SQL} SELECT * FROM ev")
def evolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their narrative's phases and their years."""
    return _evolved(spark, sf_dir)


@query(f"WITH {_EVOLVED_SQL} SELECT source, macro_topic, count(*) AS topic_count, count(*) FILTER (is_narrative_ready) AS ready_count, round(avg(dated_phases), 6) AS mean_dated_phases, CAST(sum(document_years) AS BIGINT) AS document_years, count(*) FILTER (evolution_pattern = 'growing') AS growing_topics, count(*) FILTER (evolution_pattern = 'declining') AS declining_topics, count(*) FILTER (evolution_pattern = 'steady') AS steady_topics FROM ev GROUP BY ALL")
def evolution_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.evolution_sources(_evolved(spark, sf_dir), ["source", "macro_topic"])


@query(
    f"""WITH {_REVIEW_SQL}, n AS (SELECT source, macro_topic, brand, count(DISTINCT document_id) AS k FROM base GROUP BY ALL), al AS (SELECT n.* FROM n JOIN rv USING (source, macro_topic, brand) WHERE paper_status = 'aligned'),
s AS (SELECT macro_topic, brand, count(*) FILTER (source = 'academic') AS a, count(*) FILTER (source = 'media') AS m, sum(k) FILTER (source = 'academic') AS ak, sum(k) FILTER (source = 'media') AS mk FROM al GROUP BY ALL)
SELECT n.macro_topic, n.brand, n.k AS n_documents, coalesce(a, 0) AS academic_topic_count, coalesce(m, 0) AS media_topic_count, CAST(coalesce(ak, 0) AS BIGINT) AS academic_document_count, CAST(coalesce(mk, 0) AS BIGINT) AS media_document_count,
CASE WHEN coalesce(a, 0) > 0 AND coalesce(m, 0) > 0 THEN 'aligned with both sources' ELSE 'no aligned topic of: ' || concat_ws(', ', CASE WHEN coalesce(a, 0) = 0 THEN 'academic' END, CASE WHEN coalesce(m, 0) = 0 THEN 'media' END) END AS note FROM n LEFT JOIN s USING (macro_topic, brand) WHERE n.source = 'corporate'"""
)
def appendix_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate anchors with the aligned topics and documents of either source."""
    counts = chunks(spark, sf_dir).groupBy(*BRAND).agg(F.count_distinct("document_id").alias("n_documents"))
    aligned = counts.join(reviewed(spark, sf_dir).where("paper_status = 'aligned'").select(*BRAND), BRAND)
    return reports.anchors_with_aggregates(counts.where("source = 'corporate'").drop("source"), aligned, ["macro_topic", "brand"])


@query(
    f"""WITH {_CLASS_SQL}, st AS (SELECT *, NOT (valid_lags < 3 OR close_second) AS stable FROM classed) SELECT macro_topic, source_a, precedence_class, count(*) AS pair_count, count(*) FILTER (stable) AS stable_pair_count, round(count(*) / any_value(n), 6) AS share_of_pairs, round(coalesce(count(*) FILTER (stable) / nullif(any_value(m), 0), 0), 6) AS share_of_stable
FROM st JOIN (SELECT macro_topic, source_a, count(*) AS n, count(*) FILTER (stable) AS m FROM st GROUP BY ALL) USING (macro_topic, source_a) GROUP BY ALL"""
)
def precedence_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who leads, over all pairs and over those with a stable best lag."""
    return reports.precedence_counts(relations.precedence(pair_best(spark, sf_dir)), ["macro_topic", "source_a"])


def _series_sql() -> str:
    from .registry import ORACLE_SQL

    return ORACLE_SQL["pair_annual_series"]


@query(
    f"""WITH ps AS ({_series_sql()}), n AS (SELECT pair_id, macro_topic, sum(documents_a) AS a, sum(documents_b) AS b FROM ps GROUP BY ALL), c AS (SELECT pair_id, CAST(row_number() OVER (PARTITION BY macro_topic ORDER BY least(coalesce(a, 0), coalesce(b, 0)) DESC, pair_id) AS INTEGER) AS curated_rank FROM n QUALIFY curated_rank <= 3),
l AS (SELECT pair_id, curated_rank, year, side, share FROM (SELECT pair_id, curated_rank, year, 'a' AS side, share_a AS share FROM ps JOIN c USING (pair_id) UNION ALL SELECT pair_id, curated_rank, year, 'b', share_b FROM ps JOIN c USING (pair_id)))
SELECT pair_id, curated_rank, year, side, share, round(CASE WHEN max(share) OVER (PARTITION BY pair_id, side) > 0 THEN share / max(share) OVER (PARTITION BY pair_id, side) END, 6) AS scaled_share FROM l"""
)
def curated_pair_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of the three pairs of each macro topic with the most documents on their smaller side."""
    rows = pair_annual_series(spark, sf_dir)
    sizes = rows.groupBy("pair_id", "macro_topic").agg(F.least(F.coalesce(F.sum("documents_a"), F.lit(0)), F.coalesce(F.sum("documents_b"), F.lit(0))).alias("n"))
    chosen = top_by(sizes, ["macro_topic"], [F.desc("n"), F.col("pair_id")], 3, "curated_rank").select("pair_id", "curated_rank")
    return reports.curated_series(rows, chosen, "pair_id")
