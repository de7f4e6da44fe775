"""Statistics as expressions and windows: correlations, p-values, multiple testing, concentration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pearson(x: str, y: str, least: int) -> Column:
    """Aggregate over rows where both are present: NULL with fewer than `least` or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    varied = (F.count(a) >= least) & (F.count_distinct(a) > 1) & (F.count_distinct(b) > 1)
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(column: str, partition: list[str]) -> Column:
    """Rank with ties at their mean."""
    own = Window.partitionBy(*partition)
    return F.rank().over(own.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, column)) - 1) / 2


def t_two_sided_p(r: Column, n: Column) -> Column:
    """P of a correlation r of n pairs under Student's t with n - 2 degrees of freedom, by the finite series in the angle."""
    df = (n - 2).cast("int")
    size = F.abs(r)
    angle = F.atan2(size, F.sqrt(F.greatest(F.lit(0.0), 1 - size * size)))  # of t / sqrt(df), whatever df
    sin, cos = F.sin(angle), F.cos(angle)
    # Terms of the series: even df cos^0, cos^2, ..; odd df cos^1, cos^3, ..; each from the one before.
    steps = F.when(df >= 4, F.sequence(F.lit(2) + df % 2, df - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    first = F.when(df % 2 == 0, F.lit(1.0)).otherwise(cos)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * (k - 1) / k * cos * cos
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(steps, start, add)["sum"]
    inside = F.when(df == 1, angle * 2 / math.pi).when(df % 2 == 0, sin * total).otherwise((angle + sin * total) * 2 / math.pi)
    return F.when(r.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), F.lit(1.0) - inside))


def binomial_p(k: Column, n: Column, alternative: str) -> Column:
    """Exact test of k of n against one half; NULL for n = 0."""
    n, k = n.cast("int"), k.cast("int")

    def log_choose(i: Column) -> Column:
        return F.aggregate(F.when(i > 0, F.sequence(F.lit(1), i)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + F.log((n - i + j).cast("double") / j))

    def chance(i: Column) -> Column:
        return F.exp(log_choose(i) - n * math.log(2))

    outcomes = F.sequence(F.lit(0), n)
    own = chance(k)
    keep = {"two-sided": lambda i: chance(i) <= own * (1 + 1e-7), "greater": lambda i: i >= k, "less": lambda i: i <= k}[alternative]
    total = F.aggregate(F.filter(outcomes, keep), F.lit(0.0), lambda s, i: s + chance(i))
    return F.when(n > 0, F.least(F.lit(1.0), total))


def bh_within(df: DataFrame, p: str, out: str, partition: list[str], tie: list[str]) -> DataFrame:
    """Benjamini-Hochberg q-values within each partition; NULL p-values have none and do not count."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p)))
    own = Window.partitionBy(*partition, F.col(p).isNull())
    ranked = df.withColumn("_rank", F.row_number().over(own.orderBy(clipped, *tie))).withColumn("_m", F.count(F.lit(1)).over(own))
    raw = clipped * F.col("_m") / F.col("_rank")
    after = own.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_raw", raw).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(after)))).drop("_rank", "_m", "_raw")


def bh_table(df: DataFrame, p: str, out: str, tie: list[str], cells: int = 1000) -> DataFrame:
    """q-values over the whole table without one task for all rows: ranks and suffix minima per cell of p, then over the cells."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p)))
    valid = df.where(F.col(p).isNotNull()).withColumn("_p", clipped).withColumn("_cell", F.least(F.floor(clipped * cells), F.lit(cells - 1)).cast("int"))
    sizes = valid.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))  # at most `cells` rows from here on
    over = Window.orderBy("_cell")
    sizes = sizes.select("_cell", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_m"))
    own = Window.partitionBy("_cell")
    ranked = valid.join(F.broadcast(sizes), "_cell").withColumn("_rank", F.row_number().over(own.orderBy("_p", *tie)) + F.col("_before"))
    ranked = ranked.withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    lows = ranked.groupBy("_cell").agg(F.min("_raw").alias("_low"))
    lows = lows.select("_cell", F.min("_low").over(Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    ranked = ranked.withColumn("_here", F.min("_raw").over(own.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)))
    done = ranked.join(F.broadcast(lows), "_cell").withColumn(out, F.least(F.lit(1.0), F.col("_here"), F.coalesce("_later", F.lit(1.0))))
    none = df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return done.select(*df.columns, out).unionByName(none)


def concentration(counts: DataFrame, group: list[str], n: str, tie: str) -> DataFrame:
    """Shannon entropy, effective number, HHI, Gini and the 90th percentile of counts per group."""
    own = Window.partitionBy(*group)
    shares = counts.withColumn("_p", F.col(n) / F.sum(n).over(own)).withColumn("_i", F.row_number().over(own.orderBy(n, tie)))
    entropy = -F.sum(F.col("_p") * F.log("_p"))
    gini = F.try_divide(F.sum((F.col("_i") * 2) * F.col(n)), F.count(F.lit(1)) * F.sum(n)) - (F.count(F.lit(1)) + 1) / F.count(F.lit(1))
    return shares.where(F.col(n) > 0).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_topics"), F.round(entropy, 6).alias("entropy"), F.round(F.exp(entropy), 6).alias("effective_topics"), F.round(F.sum(F.col("_p") * F.col("_p")), 6).alias("hhi"), F.round(gini, 6).alias("gini"), F.round(F.percentile(n, 0.9), 6).alias("p90")
    )
