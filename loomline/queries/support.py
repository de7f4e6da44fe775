"""Support for merging topics, from vectors, parts and their sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, support
from ..plans.corpus import table
from ..storage import join_bounded, stored
from .registry import query
from .vectors import _EMB_SQL, embedded

# A vector is a topic: its part's sales are its chunks, the orders its documents, suppliers its partners, the next vector
# its narrative. Eight topics of a group in a row are the leaves of a tree.
K, LEAST = 2, 0.20
_SQL = f"""{_EMB_SQL}, pr AS (SELECT a.label, a.source, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.source = b.source AND a.vec_id < b.vec_id
), dd AS (SELECT label, source, a AS f, b AS t, similarity FROM pr UNION ALL SELECT label, source, b, a, similarity FROM pr
), rk AS (SELECT *, row_number() OVER (PARTITION BY label, source, f ORDER BY similarity DESC, t) AS k FROM dd QUALIFY k <= {K} OR similarity >= {LEAST}
), cand AS (SELECT label, source, least(f, t) AS a, greatest(f, t) AS b, max(similarity) AS similarity, min(k) FILTER (f < t) AS rank_from_a, min(k) FILTER (f > t) AS rank_from_b FROM rk GROUP BY ALL
), sales AS (SELECT l_partkey - 1 AS vec_id, l_orderkey, year(l_shipdate) AS year, l_suppkey, l_returnflag FROM lineitem
), y AS (SELECT vec_id, year, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS doc, CAST(count(*) AS DOUBLE) AS chunk FROM sales GROUP BY ALL
), facts AS (SELECT vec_id, list(DISTINCT year) AS years, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS strict, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS same FROM sales GROUP BY vec_id
), words AS (SELECT p_partkey - 1 AS vec_id, list_distinct([p_brand, p_type, 'size ' || p_size, 'container ' || (p_partkey % 5)]) AS terms FROM part
), ser AS (SELECT a, b, year, sum(da) AS da, sum(db) AS db, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT a, b, year, doc AS da, 0.0 AS db, chunk AS ca, 0.0 AS cb FROM cand JOIN y ON y.vec_id = a UNION ALL SELECT a, b, year, 0.0, doc, 0.0, chunk FROM cand JOIN y ON y.vec_id = b) GROUP BY ALL
), co AS (SELECT a, b, CASE WHEN count(*) >= 4 AND min(da) < max(da) AND min(db) < max(db) THEN round(corr(da, db), 6) END AS doc_correlation, CASE WHEN count(*) >= 4 AND min(ca) < max(ca) AND min(cb) < max(cb) THEN round(corr(ca, cb), 6) END AS chunk_correlation FROM ser GROUP BY ALL
), lf AS (SELECT vec_id, (row_number() OVER (PARTITION BY label, source ORDER BY vec_id) - 1) AS i FROM e
), sig AS (SELECT c.label, c.source, c.a, c.b, c.similarity, rank_from_a, rank_from_b, round(list_dot_product(na.v, nb.v), 6) AS narrative_similarity,
  len(list_intersect(coalesce(wa.terms, []), coalesce(wb.terms, []))) AS term_count, len(list_intersect(coalesce(fa.years, []), coalesce(fb.years, []))) AS year_count, doc_correlation, chunk_correlation,
  len(list_intersect(coalesce(fa.strict, []), coalesce(fb.strict, []))) AS strict_partner_count, len(list_intersect(coalesce(fa.same, []), coalesce(fb.same, []))) AS same_issue_partner_count, la.i // 8 = lb.i // 8 AS hierarchical_found,
  CASE WHEN la.i // 8 = lb.i // 8 THEN CASE WHEN la.i // 2 = lb.i // 2 THEN 1.0 WHEN la.i // 4 = lb.i // 4 THEN 2.0 ELSE 3.0 END END AS ancestor_distance
  FROM cand c JOIN lf la ON la.vec_id = c.a JOIN lf lb ON lb.vec_id = c.b LEFT JOIN e na ON na.vec_id = c.a + 1 LEFT JOIN e nb ON nb.vec_id = c.b + 1 LEFT JOIN words wa ON wa.vec_id = c.a LEFT JOIN words wb ON wb.vec_id = c.b LEFT JOIN facts fa ON fa.vec_id = c.a LEFT JOIN facts fb ON fb.vec_id = c.b LEFT JOIN co ON co.a = c.a AND co.b = c.b
), counted AS (SELECT *, CAST(similarity >= 0.65 AS INTEGER) + CAST(coalesce(narrative_similarity >= 0.60, false) AS INTEGER) + CAST(term_count >= 2 AS INTEGER) + CAST(year_count >= 4 AS INTEGER) + CAST(coalesce(doc_correlation >= 0.30, false) AS INTEGER) + CAST(coalesce(chunk_correlation >= 0.30, false) AS INTEGER) + CAST(strict_partner_count > 0 AS INTEGER) + CAST(same_issue_partner_count > 0 AS INTEGER) + CAST(hierarchical_found AS INTEGER) AS support_signal_count FROM sig
)"""


@query(
    f"""WITH {_SQL} SELECT label, source, a, b, similarity, coalesce(rank_from_a, 0) AS rank_from_a, coalesce(rank_from_b, 0) AS rank_from_b, narrative_similarity, CAST(term_count AS INTEGER) AS term_count, CAST(year_count AS INTEGER) AS year_count, doc_correlation, chunk_correlation, CAST(strict_partner_count AS INTEGER) AS strict_partner_count, CAST(same_issue_partner_count AS INTEGER) AS same_issue_partner_count,
hierarchical_found, ancestor_distance, support_signal_count, CAST(row_number() OVER (PARTITION BY label, source ORDER BY support_signal_count DESC, similarity DESC, narrative_similarity DESC NULLS LAST, a, b) AS INTEGER) AS support_rank FROM counted"""
)
def merge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of topics with all nine signals, ranked."""
    within = ["label", "source"]
    rows = stored(embedded(spark, sf_dir))
    next_one = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("narrative"))
    sales = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") - 1).alias("vec_id"), "l_orderkey", F.year("l_shipdate").alias("year"), "l_suppkey", "l_returnflag")
    sales = stored(join_bounded(sales, rows.select("vec_id"), ["vec_id"], "left_semi"))
    every = sorted(r[0] for r in sales.select("year").where("year IS NOT NULL").distinct().collect())  # the years, a few
    values = sales.groupBy("vec_id", "year").agg(F.count_distinct("l_orderkey").cast("double").alias("doc"), F.count(F.lit(1)).cast("double").alias("chunk"))
    in_year = lambda c: F.array(*[F.max(F.when(F.col("year") == y, F.col(c))) for y in every]).cast("array<double>")
    years = values.groupBy("vec_id").agg(in_year("doc").alias("docs"), in_year("chunk").alias("chunks"))
    partners = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey"))).cast("array<long>")
    facts = sales.groupBy("vec_id").agg(F.collect_set("year").cast("array<long>").alias("years"), partners("R").alias("strict"), partners("A").alias("same"))
    words = F.array_distinct(F.array("p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")), F.concat(F.lit("container "), (F.col("p_partkey") % 5).cast("string"))))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("vec_id"), F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.xxhash64(w)).alias("terms"))
    own = Window.partitionBy(*within).orderBy("vec_id")  # the topics of a group
    place = rows.select(*within, "vec_id").withColumn("i", F.row_number().over(own) - 1)
    name = lambda level: F.concat_ws("/", F.lit(str(level)), "label", "source", F.floor(F.col("i") / 2**level).cast("string"))
    merges = None
    for level in (1, 2, 3):
        nodes = place.select(name(level).alias("parent"), (name(level - 1) if level > 1 else F.col("vec_id").cast("string")).alias("child")).distinct()
        level_rows = nodes.groupBy("parent").agg(F.min("child").alias("left"), F.max("child").alias("right")).withColumn("distance", F.lit(float(level)))
        merges = level_rows if merges is None else merges.unionByName(level_rows)
    held = graph.leaves(stored(merges)).distinct().groupBy(F.col("leaf").cast("long").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("distance", F.xxhash64("parent").alias("id")))).alias("m"))
    above = held.select("vec_id", F.col("m.id").alias("above"), F.col("m.distance").alias("above_at"))
    topics = rows
    for more in (next_one, parts, facts, years, above):
        topics = topics.join(more, "vec_id", "left")
    ranked = support.ranked_candidates(stored(topics), within, "vec_id", "embedding", K, LEAST).fillna(0, ["rank_from_a", "rank_from_b"])
    return ranked.select(*within, "a", "b", "similarity", "rank_from_a", "rank_from_b", "narrative_similarity", "term_count", "year_count", "doc_correlation", "chunk_correlation", "strict_partner_count", "same_issue_partner_count", "hierarchical_found", "ancestor_distance", "support_signal_count", "support_rank")
