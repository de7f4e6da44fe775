"""Samples that are the same whatever the partitions: rows are ordered by a hash of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import join_bounded


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def quotas(counts: DataFrame, group: str, n: str, total: int) -> DataFrame:
    """Largest remainders: how many of `total` each group gets in proportion to n (groups: few, ties by group)."""
    exact = F.col(n) * total / F.sum(n).over(Window.partitionBy(F.lit(1)))
    base = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(1)))
    ranked = base.withColumn("_left", left).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("_rest"), group)))
    return ranked.select(group, (F.col("_floor") + (F.col("_k") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def proportional(rows: DataFrame, group: str, key: str, total: int, seed: int) -> DataFrame:
    """`total` rows with each group's share by largest remainders."""
    quota = quotas(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, "n", total)
    ranked = rows.withColumn("sample_rank", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(key, seed), key)))
    return join_bounded(ranked, quota, [group]).where(F.col("sample_rank") <= F.col("quota"))


def round_robin(rows: DataFrame, group: str, key: str, total: int, seed: int) -> DataFrame:
    """One row of each group in turn until there are `total`."""
    ranked = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(key, seed), key)))
    return ranked.orderBy("round", group).limit(total)


def stratified(rows: DataFrame, strata: list[str], key: str, share: float, seed: int) -> DataFrame:
    """A share of each stratum, one row at least."""
    own = Window.partitionBy(*strata)
    want = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(own) * share))
    ranked = rows.withColumn("_want", want).withColumn("sample_rank", F.row_number().over(own.orderBy(hash_order(key, seed), key)))
    return ranked.where(F.col("sample_rank") <= F.col("_want")).drop("_want")


def matched_controls(rows: DataFrame, cell: str, verdict: str, hardest: list[Column], key: str) -> DataFrame:
    """All rows judged 'no', in each cell as many of the hardest 'yes', and one easy 'yes' more for coverage."""
    no = rows.where(F.col(verdict) == "no").withColumn("sample_reason", F.lit("all_no"))
    n_no = no.groupBy(cell).agg(F.count(F.lit(1)).alias("_no"))
    own = Window.partitionBy(cell)
    yes = rows.where(F.col(verdict) == "yes").join(n_no, cell, "left").fillna(0, ["_no"])
    yes = yes.withColumn("_k", F.row_number().over(own.orderBy(*hardest, key))).withColumn("_last", F.count(F.lit(1)).over(own))
    reason = F.when(F.col("_k") <= F.col("_no"), "matched_yes").when(F.col("_k") == F.col("_last"), "coverage_yes")
    return no.unionByName(yes.withColumn("sample_reason", reason).where(F.col("sample_reason").isNotNull()).drop("_no", "_k", "_last"))


def reservoir(rows: DataFrame, group: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows of each group, every one equally likely."""
    return rows.withColumn("sample_rank", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(key, seed), key))).where(F.col("sample_rank") <= size)


def most_and_least_complete(rows: DataFrame, group: str, completeness: Column, key: str) -> DataFrame:
    """Per group the row with the most and the one with the least filled fields."""
    own = Window.partitionBy(group)
    ranked = rows.withColumn("_c", completeness).withColumn("_hi", F.row_number().over(own.orderBy(F.desc("_c"), key))).withColumn("_lo", F.row_number().over(own.orderBy("_c", key)))
    role = F.when(F.col("_hi") == 1, "most_complete").when(F.col("_lo") == 1, "least_complete")
    return ranked.withColumn("sample_role", role).where(F.col("sample_role").isNotNull()).drop("_c", "_hi", "_lo")
