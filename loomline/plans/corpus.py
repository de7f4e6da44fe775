"""The chunk corpus that the series and review queries work on, from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which column values stand for which source and macro topic.
SOURCES = {"A": "academic", "N": "media", "R": "corporate"}
MACRO_TOPICS = {"ECONOMY": "T1", "LARGE": "T2", "MEDIUM": "T3", "PROMO": "T4", "SMALL": "T5", "STANDARD": "T6"}
DYADS = [("media", "corporate"), ("academic", "corporate")]

#: The same table in SQL.
BASE_SQL = """base AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'academic' WHEN 'N' THEN 'media' WHEN 'R' THEN 'corporate' END AS source,
         CASE p_type WHEN 'ECONOMY' THEN 'T1' WHEN 'LARGE' THEN 'T2' WHEN 'MEDIUM' THEN 'T3' WHEN 'PROMO' THEN 'T4' WHEN 'SMALL' THEN 'T5' WHEN 'STANDARD' THEN 'T6' END AS macro_topic,
         p_brand AS brand, p_brand || '/' || CAST(p_size AS VARCHAR) AS topic,
         l_orderkey AS document_id, CAST(year(l_shipdate) AS BIGINT) AS year,
         l_partkey AS part_id, l_linenumber AS item, l_extendedprice AS score, l_quantity AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: str, names: dict[str, str]):
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, macro_topic, brand, topic (brand and size), document_id, year and the chunk's own columns."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        mapped("l_returnflag", SOURCES).alias("source"),
        mapped("p_type", MACRO_TOPICS).alias("macro_topic"),
        F.col("p_brand").alias("brand"),
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("topic"),
        F.col("l_orderkey").alias("document_id"),
        F.year("l_shipdate").cast("long").alias("year"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").alias("item"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("size"),
    )
