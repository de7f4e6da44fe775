"""Labelled rows for the classifiers: one label per doc_id, folds, and bounded samples by a hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fold_of


def usable(labels: DataFrame, column: str, mod: int, held_out: int) -> DataFrame:
    """doc_id and label (0 or 1) outside the held-out fold. NULLs, other values and ids with both labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), mod) != held_out))
    one = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return one.where(F.col("label") == F.col("most")).drop("most")


def hashed_sample(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """The limit rows first in a hash order of doc_id: the same ones whatever the partitions."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)
