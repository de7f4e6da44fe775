"""Samples that SQL can draw too: rows in the order of an md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..plans.corpus import table
from .registry import query

_ORDER = "md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id"
_JUDGED_SQL = "j AS (SELECT doc_id, lang, n_chars, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS verdict FROM documents JOIN labels USING (doc_id))"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "lang", "n_chars", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"))


@query(
    f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), f AS (SELECT lang, n * 100 / sum(n) OVER () AS x FROM c), r AS (SELECT *, floor(x) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS k FROM f),
q AS (SELECT lang, CAST(fl + CASE WHEN k <= 100 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r),
d AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS INTEGER) AS sample_rank FROM documents)
SELECT doc_id, lang, quota, sample_rank FROM d JOIN q USING (lang) WHERE sample_rank <= quota"""
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents, each language with its share by largest remainders."""
    return sampling.proportional(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100, 7).select("doc_id", "lang", "quota", "sample_rank")


@query(f"WITH d AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS INTEGER) AS round FROM documents) SELECT doc_id, lang, round FROM d ORDER BY round, lang LIMIT 60")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents, one of each language in turn."""
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, 7)


@query(f"WITH d AS (SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY {_ORDER}) AS INTEGER) AS sample_rank, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) SELECT doc_id, lang, source, sample_rank FROM d WHERE sample_rank <= greatest(1, floor(n * 0.1))")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.1, 7)


@query(
    f"""WITH {_JUDGED_SQL}, c AS (SELECT lang, count(*) FILTER (verdict = 'no') AS n FROM j GROUP BY lang), y AS (
  SELECT j.*, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS last, n FROM j JOIN c USING (lang) WHERE verdict = 'yes'
)
SELECT doc_id, lang, verdict, 'all_no' AS sample_reason FROM j WHERE verdict = 'no'
UNION ALL SELECT doc_id, lang, verdict, CASE WHEN k <= n THEN 'matched_yes' ELSE 'coverage_yes' END FROM y WHERE k <= n OR k = last"""
)
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All refused documents, as many of the hardest accepted ones, and one easy accepted one per language."""
    return sampling.matched_controls(judged(spark, sf_dir), "lang", "verdict", [F.desc("n_chars")], "doc_id").select("doc_id", "lang", "verdict", "sample_reason")


@query(f"SELECT doc_id, source, sample_rank FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS INTEGER) AS sample_rank FROM documents) WHERE sample_rank <= 5")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5, 7)


@query(
    """WITH j AS (SELECT d.doc_id, source, CAST(quality IS NOT NULL AS INTEGER) + CAST(toxic IS NOT NULL AS INTEGER) + CAST(n_chars > 1000 AS INTEGER) AS c FROM documents d LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, doc_id) AS hi, row_number() OVER (PARTITION BY source ORDER BY c, doc_id) AS lo FROM j)
SELECT source, doc_id, CASE WHEN hi = 1 THEN 'most_complete' ELSE 'least_complete' END AS sample_role FROM r WHERE hi = 1 OR lo = 1"""
)
def completeness_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    filled = F.col("quality").isNotNull().cast("int") + F.col("toxic").isNotNull().cast("int") + (F.col("n_chars") > 1000).cast("int")
    return sampling.most_and_least_complete(docs, "source", filled, "doc_id").select("source", "doc_id", "sample_role")
