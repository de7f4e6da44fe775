"""Topics of vectors and texts: clusters of a given number, class-weighted terms, quality, supervised labels.

Clusters by density are in `density`; here k-means on unit vectors is the alternative with a fixed number of topics,
points below a similarity floor as -1.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, unit
from ..storage import join_bounded, stored
from .relational import top_by


def cluster(rows: DataFrame, key: str, vector: str, k: int, floor: float, seed: int = 42) -> DataFrame:
    """key, micro_topic_id (-1: too far from its center) and micro_topic_probability (cosine to the center, 0 at least)."""
    data = rows.select(key, unit(F.col(vector)).alias("_u")).withColumn("features", array_to_vector("_u"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_c").fit(data)
    centers = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "_c int, _center array<double>")
    near = model.transform(data).join(F.broadcast(centers), "_c").withColumn("_s", dot(F.col("_u"), unit(F.col("_center"))))
    return near.select(key, F.when(F.col("_s") >= floor, F.col("_c")).otherwise(-1).cast("long").alias("micro_topic_id"), F.round(F.greatest(F.lit(0.0), F.col("_s")), 6).alias("micro_topic_probability"))


def class_terms(terms: DataFrame, topic: str, term: str, k: int, bins: list[str] | None = None) -> DataFrame:
    """The k terms of each topic (and bin) with the largest class-based TF-IDF: tf in the topic times log(1 + mean topic size / total of the term)."""
    keys = [topic, *(bins or [])]
    tf = stored(terms.groupBy(*keys, term).agg(F.count(F.lit(1)).alias("n")))  # else the texts are cut for each of its uses
    size = Window.partitionBy(*keys)
    total = tf.groupBy(term).agg(F.sum("n").alias("_total"))
    mean = tf.groupBy(*keys).agg(F.sum("n").alias("_size")).agg(F.avg("_size").alias("_mean"))
    scored = tf.withColumn("_tf", F.col("n") / F.sum("n").over(size)).join(total, term).crossJoin(F.broadcast(mean))
    scored = scored.withColumn("weight", F.round(F.col("_tf") * F.log(1 + F.col("_mean") / F.col("_total")), 9))
    return top_by(scored, keys, [F.desc("weight"), F.col(term)], k, "term_rank").select(*keys, term, "n", "weight", "term_rank")


def supervised(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """A logistic regression with balanced classes: key, label, predicted_label and probability."""
    sizes = rows.groupBy(label).agg((1.0 / F.count(F.lit(1))).alias("_w"))
    counts = join_bounded(rows, sizes, [label]).withColumn("features", array_to_vector(unit(F.col(vector)))).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", maxIter=50, regParam=1e-4, predictionCol="_p", probabilityCol="_prob").fit(counts)
    out = model.transform(counts)
    return out.select(key, label, F.col("_p").cast("int").alias("predicted_label"), F.round(F.array_max(vector_to_array("_prob")), 6).alias("probability"))


def crosswalk(rows: DataFrame, label: str, topic: str) -> DataFrame:
    """Documents per label and topic, their share of the label, and whether the topic is the label's largest."""
    counts = rows.groupBy(label, topic).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(label)
    return counts.withColumn("share_of_label", F.round(F.col("n") / F.sum("n").over(own), 6)).withColumn("is_dominant", F.row_number().over(own.orderBy(F.desc("n"), topic)) == 1)


def year_evidence(rows: DataFrame, topic: list[str], score: list, value: str, k: int = 5) -> DataFrame:
    """Per topic and year the k best rows: as a list, numbered columns and a flag for years with fewer."""
    best = top_by(rows, [*topic, "year"], score, k, "_k")
    packed = best.groupBy(*topic, "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda x: x[value]).alias("_v"))
    columns = [F.get("_v", i).alias(f"{value}_{i + 1}") for i in range(k)]
    return packed.select(*topic, "year", F.to_json("_v").alias("records_json"), *columns, (F.size("_v") < k).alias("sparse_year"))
