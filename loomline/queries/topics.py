"""Topics: crosswalks, evidence, and fitted models, which SQL cannot say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import density, topics
from ..operators.relational import top_by
from ..plans.corpus import BASE_SQL, chunks, table
from .registry import query


@query(f"WITH {BASE_SQL}, c AS (SELECT macro_topic, brand, count(*) AS n FROM base GROUP BY ALL) SELECT macro_topic, brand, n, round(n / sum(n) OVER (PARTITION BY macro_topic), 6) AS share_of_label, row_number() OVER (PARTITION BY macro_topic ORDER BY n DESC, brand) = 1 AS is_dominant FROM c")
def label_topic_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.crosswalk(chunks(spark, sf_dir), "macro_topic", "brand")


_BEST = "ORDER BY score DESC, document_id, item, part_id"


@query(f"WITH {BASE_SQL} SELECT macro_topic, brand, document_id, item, score, CAST(row_number() OVER (PARTITION BY macro_topic, brand {_BEST}) AS INTEGER) AS rank_in_topic FROM base QUALIFY rank_in_topic <= 3")
def top_docs_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("score"), F.col("document_id"), F.col("item"), F.col("part_id")]
    return top_by(chunks(spark, sf_dir), ["macro_topic", "brand"], order, 3, "rank_in_topic").select("macro_topic", "brand", "document_id", "item", "score", "rank_in_topic")


@query(
    f"""WITH {BASE_SQL}, k AS (SELECT macro_topic, brand, year, CAST(document_id AS VARCHAR) || '::chunk_' || lpad(CAST(item AS VARCHAR), 4, '0') AS chunk_id, row_number() OVER (PARTITION BY macro_topic, brand, year {_BEST}) AS k FROM base)
SELECT macro_topic, brand, year, to_json(list(chunk_id ORDER BY k)) AS records_json, max(chunk_id) FILTER (k = 1) AS chunk_id_1, max(chunk_id) FILTER (k = 2) AS chunk_id_2, max(chunk_id) FILTER (k = 3) AS chunk_id_3, max(chunk_id) FILTER (k = 4) AS chunk_id_4, max(chunk_id) FILTER (k = 5) AS chunk_id_5, count(*) < 5 AS sparse_year
FROM k WHERE k <= 5 GROUP BY ALL"""
)
def year_evidence_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("chunk_id", text.chunk_id(F.col("document_id"), F.col("item")))
    return topics.year_evidence(rows, ["macro_topic", "brand"], [F.desc("score"), F.col("document_id"), F.col("item"), F.col("part_id")], "chunk_id")


_W = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"


@query(
    f"""WITH t AS (SELECT lang, unnest(list_filter({_W}, lambda w: length(w) >= 3)) AS term FROM documents), tf AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS f, sum(n) OVER (PARTITION BY term) AS total FROM tf),
m AS (SELECT avg(z) AS mean FROM (SELECT sum(n) AS z FROM tf GROUP BY lang)), w AS (SELECT lang, term, n, round(f * ln(1 + mean / total), 9) AS weight FROM s CROSS JOIN m)
SELECT lang, term, n, weight, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INTEGER) AS term_rank FROM w QUALIFY term_rank <= 8"""
)
def terms_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that tell each language apart."""
    terms = table(spark, sf_dir, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("term"))
    return topics.class_terms(terms, "lang", "term", 8)


@query()
def topic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the vectors of each label by density; -1 is noise."""
    return density.density_clusters(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


@query()
def topic_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the vectors, fitted; -1 for those far from every center."""
    return topics.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 0.1)


@query()
def supervised_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.supervised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
