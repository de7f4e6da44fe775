"""Tables for readers of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import series, serving
from ..operators.relational import top_by
from ..operators.topics import class_terms
from ..plans.corpus import BASE_SQL, chunks, table
from ..storage import join_bounded
from .registry import query
from .series import _CORR_SQL, _PREV_SQL, LAGS, LEAST, brand_prevalence
from .vectors import _MNN_SQL, cross_source, embedded


@query(
    f"""WITH {_MNN_SQL}, p AS (SELECT vec_id_a AS vec_id, vec_id_b AS c, similarity FROM mn), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, c) AS k FROM p),
g AS (SELECT vec_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS cs FROM p WHERE similarity >= 0.20 GROUP BY vec_id)
SELECT e.vec_id, e.source, b.c AS best_counterpart, b.similarity AS best_similarity, coalesce(n, 0) AS qualifying_pairs, coalesce(cs, '') AS counterparts, CASE WHEN n > 0 THEN 'direct_pair_above_threshold' WHEN b.c IS NULL THEN 'no_pair' ELSE 'below_threshold' END AS inclusion_reason, coalesce(n, 0) > 0 AS is_included
FROM e LEFT JOIN b ON b.vec_id = e.vec_id AND k = 1 LEFT JOIN g ON g.vec_id = e.vec_id WHERE e.source <> 'corporate'"""
)
def inclusion_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External topics with a corporate counterpart above the threshold, and the others with the reason."""
    pairs = cross_source(spark, sf_dir, 1, 0.20).select(F.col("vec_id_a").alias("vec_id"), F.col("vec_id_b").alias("counterpart"), "similarity")
    topics = embedded(spark, sf_dir).where(F.col("source") != "corporate").select("vec_id", "source")
    return serving.include_by_best(pairs, topics, "vec_id", 0.20)


@query("WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN 'Override ' || p_brand WHEN p_partkey % 20 = 10 THEN ' ' END AS label FROM part WHERE p_partkey % 10 = 0) SELECT p.p_partkey, coalesce(nullif(trim(o.label), ''), p_name) AS label, o.p_partkey IS NOT NULL AS is_overridden FROM part p LEFT JOIN o USING (p_partkey)")
def label_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 20 == 0, F.concat(F.lit("Override "), "p_brand")).when(F.col("p_partkey") % 20 == 10, " ")
    changes = parts.where(F.col("p_partkey") % 10 == 0).select("p_partkey", label.alias("label"))
    return serving.overridden(parts.select("p_partkey", F.col("p_name").alias("label")), changes, "p_partkey", ["label"])


@query(
    """WITH r AS (SELECT conv_id, turn, nullif(trim(CASE WHEN role = 'user' THEN text END), '') AS question, nullif(trim(CASE WHEN role = 'assistant' THEN text END), '') AS answer, nullif(trim(CASE WHEN role = 'system' THEN text END), '') AS setting, text FROM conversations),
m AS (SELECT conv_id, arg_min(question, (turn, text)) FILTER (question IS NOT NULL) AS question, arg_min(answer, (turn, text)) FILTER (answer IS NOT NULL) AS answer, arg_min(setting, (turn, text)) FILTER (setting IS NOT NULL) AS setting FROM r GROUP BY conv_id)
SELECT *, CAST((question IS NOT NULL)::INTEGER + (answer IS NOT NULL)::INTEGER + (setting IS NOT NULL)::INTEGER AS INTEGER) AS record_score, question IS NOT NULL AND answer IS NOT NULL AND setting IS NOT NULL AS is_ready FROM m"""
)
def merged_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filled value of each field over a conversation's turns, and whether all fields are there."""
    part = lambda role: F.when(F.col("role") == role, F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", part("user").alias("question"), part("assistant").alias("answer"), part("system").alias("setting"))
    return serving.merged_records(rows, "conv_id", ["question", "answer", "setting"], [F.col("turn"), F.col("text")])


@query(f"WITH {_PREV_SQL}, a AS (SELECT *, abs(year - 1998) AS distance FROM prev WHERE document_count > 0 AND year <> 1998) SELECT source, macro_topic, brand, year, document_count, distance FROM (SELECT *, row_number() OVER (PARTITION BY source, macro_topic, brand ORDER BY distance, year) AS k FROM a) WHERE k = 1")
def nearest_year_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the year asked for, the evidence of the nearest other one."""
    rows = brand_prevalence(spark, sf_dir).where((F.col("document_count") > 0) & (F.col("year") != 1998))
    return serving.nearest_year(rows, ["source", "macro_topic", "brand"], F.lit(1998)).select("source", "macro_topic", "brand", "year", "document_count", "distance")


@query(
    f"""WITH {BASE_SQL}, b AS (SELECT source, macro_topic, year, list(DISTINCT brand) AS w FROM base GROUP BY ALL), l AS (SELECT *, lag(w) OVER (PARTITION BY source, macro_topic ORDER BY year) AS p FROM b)
SELECT source, macro_topic, year, CAST(len(w) AS INTEGER) AS words, round(len(list_intersect(w, p)) / (len(w) + len(p) - len(list_intersect(w, p))), 9) AS overlap_with_previous FROM l"""
)
def year_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a year's set of words shares with the year before."""
    rows = chunks(spark, sf_dir).groupBy("source", "macro_topic", "year").agg(F.collect_set("brand").alias("w"))
    return serving.previous_overlap(rows, ["source", "macro_topic"], "w").select("source", "macro_topic", "year", F.size("w").alias("words"), "overlap_with_previous")


_CLEANED = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'academic' WHEN 1 THEN 'media' ELSE 'corporate' END AS kind, {_CLEANED} AS c FROM documents), w AS (SELECT *, string_split(c, ' ') AS ws FROM d)
SELECT doc_id, kind, CASE kind WHEN 'academic' THEN 'https://doi.org/' WHEN 'media' THEN 'https://news.example/' ELSE 'filing ' END || CAST(doc_id AS VARCHAR) AS reference,
  md5(CASE kind WHEN 'corporate' THEN c WHEN 'media' THEN CASE WHEN len(ws) <= 30 THEN c ELSE regexp_replace(array_to_string(ws[1:30], ' '), '[ ,;:]+$', '') || ' ...' END ELSE CASE WHEN length(c) <= 120 THEN c ELSE rtrim(substr(c, 1, 119)) || '…' END END) AS display_md5 FROM w"""
)
def display_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be shown of each kind of source, and where it comes from."""
    kind = F.when(F.col("doc_id") % 3 == 0, "academic").when(F.col("doc_id") % 3 == 1, "media").otherwise("corporate")
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), "text")
    return rows.select("doc_id", "kind", serving.reference_link(F.col("kind"), F.col("doc_id").cast("string")).alias("reference"), F.md5(serving.display_text(F.col("kind"), F.col("text"))).alias("display_md5"))


@query(
    r"""WITH i AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_item' || (1 + o_orderkey % 9) || 'A' END || strftime(o_orderdate, '_%Y%m%d') AS id FROM orders),
p AS (SELECT o_orderkey, regexp_extract(id, '^(\d{10}-\d{2}-\d{6})_item([0-9A-Za-z]+)_(\d{8})$', ['accession', 'item', 'day']) AS p FROM i)
SELECT o_orderkey, nullif(p.accession, '') AS accession, nullif(p.item, '') AS item, CASE WHEN p.day = '' THEN '' ELSE substr(p.day, 1, 4) || '-' || substr(p.day, 5, 2) || '-' || substr(p.day, 7, 2) END AS filing_date FROM p"""
)
def filing_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accession, item and date out of an identifier, which has the last six digits of the key; one in five is malformed, without an item."""
    key = F.col("o_orderkey")
    item = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("_item"), (1 + key % 9).cast("string"), F.lit("A")))
    identifier = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"), F.date_format("o_orderdate", "yy"), F.lit("-"), F.lpad((key % 1_000_000).cast("string"), 6, "0"), item, F.date_format("o_orderdate", "_yyyyMMdd"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", serving.filing_parts(identifier).alias("p"))
    return rows.select("o_orderkey", F.col("p.accession").alias("accession"), F.col("p.item").alias("item"), F.col("p.date").alias("filing_date"))


@query(
    f"""WITH {_CORR_SQL}, st AS (
  SELECT source, macro_topic, brand, min(year) FILTER (document_count > 0) AS first_year, max(year) FILTER (document_count > 0) AS last_year, round(avg(prevalence), 6) AS mean_share, CAST(sum(document_count) AS BIGINT) AS documents FROM prev GROUP BY ALL
)
SELECT a.macro_topic, a.brand, a.source AS source_a, a.first_year AS first_year_a, b.first_year AS first_year_b, b.first_year - a.first_year AS first_year_gap, a.last_year AS last_year_a, b.last_year AS last_year_b, a.mean_share AS mean_share_a, b.mean_share AS mean_share_b,
       round(a.documents / b.documents, 6) AS document_ratio FROM st a JOIN st b ON a.macro_topic = b.macro_topic AND a.brand = b.brand WHERE a.source <> 'corporate' AND b.source = 'corporate'"""
)
def pair_descriptive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last years, mean shares and the ratio of documents of both sides of a pair."""
    active = F.col("document_count") > 0
    facts = brand_prevalence(spark, sf_dir).groupBy("source", "macro_topic", "brand").agg(F.min(F.when(active, F.col("year"))).alias("first_year"), F.max(F.when(active, F.col("year"))).alias("last_year"), F.round(F.avg("annual_document_prevalence"), 6).alias("mean_share"), F.sum("document_count").alias("documents"))
    a, b = (facts.select("macro_topic", "brand", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "first_year", "last_year", "mean_share", "documents")]) for s in ("a", "b"))
    pairs = a.where(F.col("source_a") != "corporate").join(b.where(F.col("source_b") == "corporate"), ["macro_topic", "brand"])
    return pairs.select("macro_topic", "brand", "source_a", "first_year_a", "first_year_b", (F.col("first_year_b") - F.col("first_year_a")).alias("first_year_gap"), "last_year_a", "last_year_b", "mean_share_a", "mean_share_b", F.round(F.col("documents_a") / F.col("documents_b"), 6).alias("document_ratio"))


@query(
    f"""WITH {BASE_SQL}, lags(lag) AS (SELECT unnest([-2, -1, 0, 1, 2])), c AS (SELECT source, macro_topic, brand, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL), d AS (SELECT source, macro_topic, year, count(DISTINCT document_id) AS d FROM base GROUP BY ALL),
g AS (SELECT source, macro_topic, CAST(replace(brand, 'Brand#', '') AS INTEGER) % 4 AS anchor, year, sum(n) AS n FROM c GROUP BY ALL), s AS (SELECT source, macro_topic, anchor, year, round(n / d, 9) AS v FROM g JOIN d USING (source, macro_topic, year)),
al AS (SELECT x.macro_topic, x.anchor, x.source AS external_source, CAST(lag AS INTEGER) AS lag, x.v AS xv, y.v AS yv FROM s x CROSS JOIN lags LEFT JOIN s y ON y.source = 'corporate' AND y.macro_topic = x.macro_topic AND y.anchor = x.anchor AND y.year = x.year + lag WHERE x.source <> 'corporate')
SELECT macro_topic, anchor, external_source, lag, count(yv) AS n_overlap_years, CASE WHEN count(yv) >= 4 AND count(DISTINCT xv) FILTER (yv IS NOT NULL) > 1 AND count(DISTINCT yv) > 1 THEN round(covar_pop(xv, yv) / nullif(stddev_pop(xv) FILTER (yv IS NOT NULL) * stddev_pop(yv), 0), 9) END AS correlation FROM al GROUP BY ALL"""
)
def aggregated_lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics summed per anchor, documents of several topics counting in each, then correlated over lags."""
    base = chunks(spark, sf_dir)
    counts = series.annual_counts(base, ["source", "macro_topic", "brand"]).withColumn("anchor", F.replace("brand", F.lit("Brand#"), F.lit("")).cast("int") % 4)
    totals = series.annual_counts(base, ["source", "macro_topic"], "d", "_c").drop("_c")
    values = counts.groupBy("source", "macro_topic", "anchor", "year").agg(F.sum("document_count").alias("n")).join(totals, ["source", "macro_topic", "year"])
    values = values.select("source", "macro_topic", "anchor", "year", F.round(F.col("n") / F.col("d"), 9).alias("v"))
    keys = ["macro_topic", "anchor", "external_source"]
    left = values.where(F.col("source") != "corporate").select("macro_topic", "anchor", F.col("source").alias("external_source"), "year", F.col("v").alias("x"))
    corporate = values.where(F.col("source") == "corporate").select("macro_topic", "anchor", "year", F.col("v").alias("y"))
    right = corporate.withColumn("external_source", F.explode(F.array(F.lit("academic"), F.lit("media"))))
    return series.lag_correlation(series.lagged(left, right, keys, LAGS), keys, LEAST)


@query(
    f"""WITH {BASE_SQL}, t AS (SELECT macro_topic, brand, count(*) AS n FROM base WHERE source = 'academic' GROUP BY ALL), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY macro_topic), 9) AS share FROM t), k AS (SELECT * FROM s WHERE CAST(replace(brand, 'Brand#', '') AS INTEGER) % 3 <> 0)
SELECT macro_topic, brand, n, share AS share_of_all, round(sum(share) OVER (PARTITION BY macro_topic ORDER BY n DESC, brand ROWS UNBOUNDED PRECEDING), 6) AS cumulative_share FROM k"""
)
def approved_topic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of all topics, cumulated over the allowed ones only."""
    counts = chunks(spark, sf_dir).where(F.col("source") == "academic").groupBy("macro_topic", "brand").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share_of_all", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("macro_topic")), 9))
    allowed = shares.where(F.replace("brand", F.lit("Brand#"), F.lit("")).cast("int") % 3 != 0)
    running = Window.partitionBy("macro_topic").orderBy(F.desc("n"), "brand").rowsBetween(Window.unboundedPreceding, 0)
    return allowed.withColumn("cumulative_share", F.round(F.sum("share_of_all").over(running), 6))


@query(
    f"""WITH {BASE_SQL}, g AS (SELECT macro_topic, to_json(list_sort(list(DISTINCT brand))) AS members FROM base WHERE source = 'corporate' GROUP BY macro_topic), x AS (SELECT DISTINCT macro_topic, unnest(from_json(members, '["VARCHAR"]')) AS brand FROM g)
SELECT macro_topic, brand, count(DISTINCT document_id) AS documents FROM base JOIN x USING (macro_topic, brand) WHERE source = 'media' GROUP BY ALL"""
)
def exploded_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups kept as JSON lists, taken apart and joined again."""
    base = chunks(spark, sf_dir)
    lists = base.where(F.col("source") == "corporate").groupBy("macro_topic").agg(F.to_json(F.array_sort(F.collect_set("brand"))).alias("members"))
    members = lists.select("macro_topic", F.explode(F.from_json("members", "array<string>")).alias("brand")).distinct()
    return join_bounded(base.where(F.col("source") == "media"), members, ["macro_topic", "brand"]).groupBy("macro_topic", "brand").agg(F.count_distinct("document_id").alias("documents"))


@query(
    """WITH t AS (SELECT lang, n_chars % 2 AS bin, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) >= 3)) AS term FROM documents), tf AS (SELECT lang, bin, term, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, bin) AS f, sum(n) OVER (PARTITION BY term) AS total FROM tf), m AS (SELECT avg(z) AS mean FROM (SELECT sum(n) AS z FROM tf GROUP BY lang, bin)), w AS (SELECT lang, bin, term, n, round(f * ln(1 + mean / total), 9) AS weight FROM s CROSS JOIN m)
SELECT lang, bin, term, n, weight, CAST(row_number() OVER (PARTITION BY lang, bin ORDER BY weight DESC, term) AS INTEGER) AS term_rank FROM w QUALIFY term_rank <= 5"""
)
def topics_over_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic's characteristic terms within each bin."""
    rows = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 2).alias("bin"), F.explode(text.tokens(F.col("text"))).alias("term"))
    return class_terms(rows, "lang", "term", 5, ["bin"])


@query("SELECT c_mktsegment, c_custkey, c_acctbal, k AS rank_in_segment FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS INTEGER) AS k FROM customer) WHERE k <= 4")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return top_by(rows, ["c_mktsegment"], [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], 4, "rank_in_segment")


@query()
def silhouette_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of a bounded sample of each label's vectors."""
    return serving.silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 40)
