"""Texts as vectors by the hashing encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoding
from ..plans.corpus import table
from .registry import query

DIMS = 16


@query(
    f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) >= 3)) AS w FROM documents), h AS (SELECT doc_id, CAST(md5_number_lower(w) % {DIMS} AS INTEGER) AS i, sum(1 - 2 * CAST(md5_number_upper(w) % 2 AS INTEGER)) AS v FROM t GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM h GROUP BY doc_id), g AS (SELECT doc_id, CAST(i AS INTEGER) AS i FROM documents, (SELECT unnest(range({DIMS})) AS i))
SELECT g.doc_id, g.i, round(coalesce(CASE WHEN n = 0 THEN 0 ELSE v / n END, 0), 6) + 0.0 AS x FROM g LEFT JOIN h USING (doc_id, i) LEFT JOIN n USING (doc_id)"""
)
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's vector, a row per dimension."""
    docs = table(spark, sf_dir, "documents")
    vectors = encoding.encode_texts(docs, "doc_id", "text", f"hashing-{DIMS}", lambda: encoding.HashingEncoder(DIMS), DIMS)
    return vectors.select("doc_id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))
