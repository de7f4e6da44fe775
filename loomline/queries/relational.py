"""Sources' subsets and summaries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import BASE_SQL, chunks, table
from .registry import query


@query("SELECT s_nationkey, r_name, count(*) AS rows_kept, count(DISTINCT CAST(s_name AS VARCHAR)) AS distinct_names, round(avg(s_acctbal), 6) AS mean_balance, round(median(s_acctbal), 6) AS median_balance FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' OR (r_name = 'EUROPE' AND s_nationkey IN (1, 6, 7)) GROUP BY ALL")
def source_subset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of one source, and of another the listed sectors only; both filters reach the scans."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = nations.where((F.col("r_name") == "ASIA") | ((F.col("r_name") == "EUROPE") & F.col("n_nationkey").isin(1, 6, 7))).select("n_nationkey", "r_name")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(wanted), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are few
    return rows.groupBy("s_nationkey", "r_name").agg(F.count(F.lit(1)).alias("rows_kept"), F.count_distinct(F.col("s_name").cast("string")).alias("distinct_names"), F.round(F.avg("s_acctbal"), 6).alias("mean_balance"), F.round(F.median("s_acctbal"), 6).alias("median_balance"))


@query(
    f"""WITH {BASE_SQL}, d AS (SELECT source, document_id, count(*) AS k, max(CAST(size > 45 AS INTEGER)) AS large FROM base WHERE year >= 1996 AND macro_topic IN ('T1', 'T3') GROUP BY ALL)
SELECT source, count(*) AS documents, CAST(sum(k) AS BIGINT) AS chunks, round(avg(k), 6) AS mean_chunks, round(median(k), 6) AS median_chunks, max(k) AS max_chunks, CAST(sum(large) AS BIGINT) AS documents_with_large FROM d GROUP BY source"""
)
def subset_chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per document, then their mean, median and largest; documents with any large chunk."""
    rows = chunks(spark, sf_dir).where((F.col("year") >= 1996) & F.col("macro_topic").isin("T1", "T3"))
    per = rows.groupBy("source", "document_id").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("size") > 45).alias("large"))
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("k").alias("chunks"), F.round(F.avg("k"), 6).alias("mean_chunks"), F.round(F.median("k"), 6).alias("median_chunks"), F.max("k").alias("max_chunks"), F.count_if("large").alias("documents_with_large"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 1.0 / 3) AS a, quantile_cont(o_totalprice, 2.0 / 3) AS b FROM orders) SELECT o_orderpriority, CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(min(o_totalprice), 6) AS least, round(max(o_totalprice), 6) AS most FROM orders CROSS JOIN q GROUP BY ALL")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tertiles by exact quantiles; the upper edge belongs to the band."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    cuts = rows.agg(F.percentile("o_totalprice", 1 / 3).alias("a"), F.percentile("o_totalprice", 2 / 3).alias("b"))
    band = F.when(F.col("o_totalprice") <= F.col("a"), "low").when(F.col("o_totalprice") <= F.col("b"), "middle").otherwise("high")
    out = rows.crossJoin(F.broadcast(cuts)).withColumn("band", band)
    return out.groupBy("o_orderpriority", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice"), 6).alias("least"), F.round(F.max("o_totalprice"), 6).alias("most"))


@query("SELECT coalesce(c_mktsegment, 'ALL') AS segment, count(*) AS customers, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal), 2) AS balance, count(*) FILTER (c_acctbal < 0) AS negative FROM customer GROUP BY ROLLUP (c_mktsegment)")
def rollup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All and each segment, in one pass."""
    rows = table(spark, sf_dir, "customer").rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("c_nationkey").alias("nations"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
    return rows.select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), "customers", "nations", "balance", "negative")


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS events, round(sum(value), 6) AS total, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY ALL")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
