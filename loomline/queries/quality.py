"""Quality of topics: sources of a language as topics of a group, by their top terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import coherence, topics
from ..plans.corpus import table
from ..storage import stored
from .registry import query

TOP = 10
_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) >= 3)"
_TOPS_SQL = f"""d AS (SELECT doc_id, lang, source AS topic, {_WORDS} AS ws FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
), tf AS (SELECT lang, topic, term, count(*) AS n FROM (SELECT lang, topic, unnest(ws) AS term FROM d) GROUP BY ALL
), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, topic) AS f, sum(n) OVER (PARTITION BY term) AS total FROM tf
), z AS (SELECT avg(x) AS mean FROM (SELECT sum(n) AS x FROM tf GROUP BY lang, topic)
), top AS (SELECT lang, topic, term FROM (SELECT lang, topic, term, row_number() OVER (PARTITION BY lang, topic ORDER BY round(f * ln(1 + mean / total), 9) DESC, term) AS k FROM s, z) WHERE k <= {TOP}
), vocab AS (SELECT DISTINCT lang, term FROM top
), held AS (SELECT d.lang, doc_id, term FROM (SELECT lang, doc_id, unnest(list_distinct(ws)) AS term FROM d) d JOIN vocab USING (lang, term)
), df AS (SELECT lang, term, count(*) AS n FROM held GROUP BY ALL
), m AS (SELECT lang, count(*) AS m FROM d WHERE len(ws) > 0 GROUP BY lang
), cnt AS (SELECT x.lang, x.topic, a.term AS term_a, b.term AS term_b, count(*) AS c FROM top x JOIN top y ON y.lang = x.lang AND y.topic = x.topic AND x.term < y.term JOIN held a ON a.lang = x.lang AND a.term = x.term JOIN held b ON b.lang = y.lang AND b.term = y.term AND b.doc_id = a.doc_id GROUP BY ALL
), pr AS (SELECT x.lang, x.topic, x.term AS term_a, y.term AS term_b, coalesce(c, 0) AS pair_documents, CASE WHEN c IS NULL THEN -1.0 ELSE round(ln(c * m / (da.n * db.n)) / nullif(-ln(c / m), 0), 9) END AS npmi
  FROM top x JOIN top y ON y.lang = x.lang AND y.topic = x.topic AND x.term < y.term JOIN m ON m.lang = x.lang LEFT JOIN cnt ON cnt.lang = x.lang AND cnt.topic = x.topic AND term_a = x.term AND term_b = y.term LEFT JOIN df da ON da.lang = x.lang AND da.term = x.term LEFT JOIN df db ON db.lang = y.lang AND db.term = y.term
), cell AS (SELECT lang, topic, term_a AS term, term_b AS other, greatest(coalesce(npmi, 0), 0) AS v FROM pr UNION ALL SELECT lang, topic, term_b, term_a, greatest(coalesce(npmi, 0), 0) FROM pr UNION ALL SELECT DISTINCT lang, topic, term, term, 1.0 FROM (SELECT lang, topic, term_a AS term FROM pr UNION SELECT lang, topic, term_b FROM pr)
), vec AS (SELECT lang, topic, term, other, v / sqrt(sum(v * v) OVER (PARTITION BY lang, topic, term)) AS v FROM cell
), mid AS (SELECT lang, topic, other, avg(v) AS c FROM vec GROUP BY ALL
), cv AS (SELECT lang, topic, round(avg(d / len), 6) AS coherence_cv FROM (SELECT lang, topic, term, sum(v * c) AS d FROM vec JOIN mid USING (lang, topic, other) GROUP BY ALL) JOIN (SELECT lang, topic, sqrt(sum(c * c)) AS len FROM mid GROUP BY ALL) USING (lang, topic) GROUP BY ALL
), sets AS (SELECT lang, topic, list(term) AS s FROM top GROUP BY ALL
), ov AS (SELECT a.lang, a.topic AS a, b.topic AS b FROM sets a JOIN sets b ON a.lang = b.lang AND a.topic < b.topic WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.5
), near AS (SELECT lang, a AS topic FROM ov UNION SELECT lang, b FROM ov
), q AS (SELECT lang, topic, topic_size, round(topic_size / sum(topic_size) OVER (PARTITION BY lang), 6) AS topic_share_non_outlier, topic_size / sum(topic_size) OVER (PARTITION BY lang) AS p, coherence_npmi, coherence_cv,
  concat_ws(';', CASE WHEN near.topic IS NOT NULL THEN 'high_top_word_overlap' END, CASE WHEN coherence_cv < 0.35 THEN 'low_cv_coherence' END) AS validation_flags
  FROM (SELECT lang, topic, count(*) AS topic_size FROM d GROUP BY ALL) LEFT JOIN (SELECT lang, topic, round(avg(npmi), 6) AS coherence_npmi FROM pr GROUP BY ALL) USING (lang, topic) LEFT JOIN cv USING (lang, topic) LEFT JOIN near USING (lang, topic)
)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their topic, the topics' top terms, similar sets of top terms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("topic"), "text").where(F.col("lang").isNotNull() & F.col("topic").isNotNull())
    words = docs.select(F.struct("lang", "topic").alias("t"), F.explode(text.tokens(F.col("text"))).alias("term"))
    tops = stored(topics.class_terms(words, "t", "term", TOP).select("t.lang", "t.topic", "term", "term_rank"))
    sets = tops.groupBy("lang", "topic").agg(F.collect_list("term").alias("s"))
    return docs, tops, stored(coherence.similar_sets(sets, ["lang"], "topic", "s", coherence.HIGH_OVERLAP))


def _pairs(docs: DataFrame, tops: DataFrame) -> DataFrame:
    lists, counts = coherence.term_lists(docs, ["lang"], "doc_id", text.tokens(F.col("text")), tops)
    return stored(coherence.pair_npmi(lists, counts, ["lang"], tops))


def _topics(docs: DataFrame, tops: DataFrame, overlaps: DataFrame) -> DataFrame:
    sizes = docs.groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("topic_size"))
    return coherence.topic_quality(sizes, coherence.coherence(_pairs(docs, tops), ["lang"]), overlaps, ["lang"])


@query(f"WITH {_TOPS_SQL} SELECT lang, topic, term_a, term_b, pair_documents, round(npmi, 6) AS npmi FROM pr")
def topic_pair_npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised pointwise mutual information of the pairs of each topic's top terms, over the documents of its group."""
    docs, tops, _ = _inputs(spark, sf_dir)
    return _pairs(docs, tops).withColumn("npmi", F.round("npmi", 6))


@query(f"WITH {_TOPS_SQL} SELECT lang, topic, topic_size, topic_share_non_outlier, coherence_npmi, coherence_cv, validation_flags, validation_flags <> '' AS is_flagged_for_review FROM q")
def topic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their coherence and flags."""
    return _topics(*_inputs(spark, sf_dir)).select("lang", "topic", "topic_size", "topic_share_non_outlier", "coherence_npmi", "coherence_cv", "validation_flags", "is_flagged_for_review")


@query(
    f"""WITH {_TOPS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY topic_size, topic) AS i FROM q)
SELECT lang, count(*) AS n_topics_non_outlier, max(topic_size) AS largest_topic_size, round(max(p), 6) AS largest_topic_share_non_outlier, round(avg(topic_size), 6) AS mean_topic_size, round(quantile_cont(topic_size, 0.5), 6) AS median_topic_size, round(quantile_cont(topic_size, 0.9), 6) AS p90_topic_size,
round(-sum(p * ln(p)), 6) AS topic_size_entropy, round(exp(-sum(p * ln(p))), 6) AS effective_number_of_topics, round(sum(p * p), 6) AS topic_size_hhi, round(2 * sum(i * topic_size) / (count(*) * sum(topic_size)) - (count(*) + 1) / count(*), 6) AS topic_size_gini, round(avg(coherence_npmi), 6) AS mean_coherence_npmi, round(avg(coherence_cv), 6) AS mean_coherence_cv,
count(*) FILTER (validation_flags <> '') AS flagged_topics, max(diversity) AS topic_diversity, coalesce(max(pairs), 0) AS high_overlap_pair_count
FROM i LEFT JOIN (SELECT lang, round(count(DISTINCT term) / count(*), 6) AS diversity FROM top GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, count(*) AS pairs FROM ov GROUP BY lang) USING (lang) GROUP BY lang"""
)
def topic_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of topics: sizes, evenness, diversity and coherence."""
    docs, tops, overlaps = _inputs(spark, sf_dir)
    return coherence.group_summary(_topics(docs, tops, overlaps), tops, overlaps, ["lang"])
