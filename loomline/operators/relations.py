"""Who leads: labels from best lags, stability and floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 0.30


def unstable(valid_lags: Column, close_second: Column) -> Column:
    """Fewer than three valid lags, or a second one almost as strong."""
    return (valid_lags < 3) | close_second


def precedence(best: DataFrame, floor: float = FLOOR) -> DataFrame:
    """precedence_class and reason by the size of r: an unstable or weak relation is synchronous or unclear."""
    unclear = F.col("best_lag").isNull() | unstable(F.col("valid_lags"), F.col("close_second")) | (F.abs("best_correlation") < floor)
    kind = F.when(F.coalesce(unclear, F.lit(True)), "synchronous_or_unclear").when(F.col("best_lag") > 0, "source_a_leads").when(F.col("best_lag") < 0, "source_b_leads").otherwise("synchronous_or_unclear")
    reason = F.when(F.coalesce(unclear, F.lit(True)), "low_information_or_unclear").when(F.col("best_lag") > 0, "positive_best_lag_docs").when(F.col("best_lag") < 0, "negative_best_lag_docs").otherwise("zero_best_lag_docs")
    return best.withColumn("precedence_class", kind).withColumn("precedence_reason", reason)


def temporal_group(best: DataFrame, floor: float = FLOOR) -> DataFrame:
    """temporal_group and reason by the signed r."""
    reason = (
        F.when(F.col("best_lag").isNull() | F.col("best_correlation").isNull(), "missing_lag_or_correlation")
        .when(unstable(F.col("valid_lags"), F.col("close_second")), "unstable_series")
        .when(F.col("best_correlation") < floor, "correlation_below_floor")
        .when(F.col("best_lag") > 0, "positive_best_lag_docs")
        .when(F.col("best_lag") < 0, "negative_best_lag_docs")
        .otherwise("zero_best_lag_docs")
    )
    group = F.when(F.col("temporal_reason") == "positive_best_lag_docs", "A_precedes_B").when(F.col("temporal_reason") == "negative_best_lag_docs", "B_precedes_A").when(F.col("temporal_reason") == "zero_best_lag_docs", "synchronous").otherwise("indeterminate")
    return best.withColumn("temporal_reason", reason).withColumn("temporal_group", group)


def relation_label(best: DataFrame, floor: float = FLOOR) -> DataFrame:
    """temporal_relation_label and reason of the best Spearman lag; close seconds are marked, not refused."""
    ambiguous = F.when(F.col("close_second"), "_ambiguous").otherwise("")
    weak = F.col("best_correlation").isNull() | (F.abs("best_correlation") < floor)
    reason = (
        F.when(F.col("best_lag").isNull(), "no_valid_lag")
        .when(weak, "correlation_below_floor")
        .when(F.col("best_lag") > 0, F.concat(F.lit("positive_best_lag_external_leads"), ambiguous))
        .when(F.col("best_lag") < 0, F.concat(F.lit("negative_best_lag_corporate_leads"), ambiguous))
        .otherwise("zero_best_lag")
    )
    label = F.when(F.col("best_lag").isNull() | weak, "synchronous_or_unclear").when(F.col("best_lag") > 0, "external_leads").when(F.col("best_lag") < 0, "corporate_leads").otherwise("synchronous_or_unclear")
    return best.withColumn("temporal_relation_label", label).withColumn("temporal_relation_reason", reason)


def precedence_summary(rows: DataFrame, groups: list[str], pair: str) -> DataFrame:
    """Pairs, their share, mean and median r, mean size of the lag and counts per group."""
    total = rows.agg(F.count_distinct(pair).alias("_all"))
    out = rows.groupBy(*groups).agg(
        F.count_distinct(pair).alias("pair_count"),
        F.round(F.avg("best_correlation"), 6).alias("mean_best_correlation"),
        F.round(F.median("best_correlation"), 6).alias("median_best_correlation"),
        F.round(F.avg(F.abs("best_lag")), 6).alias("mean_abs_best_lag"),
        F.count_if(F.coalesce("best_lag", F.lit(0)) == 0).alias("zero_lag_count"),
        F.count_if(F.col("precedence_class") == "synchronous_or_unclear").alias("synchronous_or_unclear_count"),
    )
    return out.crossJoin(F.broadcast(total)).withColumn("share_of_pairs", F.round(F.col("pair_count") / F.col("_all"), 6)).drop("_all")
