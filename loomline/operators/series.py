"""Annual series: counts, prevalence on dense grids, indices, peaks, lags and rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import safe_ratio, safe_share
from ..functions.stats import average_rank, pearson
from ..storage import spread, stored


def annual_counts(chunks: DataFrame, keys: list[str], documents: str = "document_count", rows: str = "chunk_count") -> DataFrame:
    """Distinct documents and chunk rows per keys and year, in one pass."""
    return chunks.groupBy(*keys, "year").agg(F.count_distinct("document_id").alias(documents), F.count(F.lit(1)).alias(rows))


def document_cells(chunks: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    """Distinct documents (d) and chunk rows (f) per keys and year. Sums of d_year are those of totals and year, of d_total those of totals.

    keys: totals and others. A document's rows meet in one task, where it is marked once per totals and year and once per
    totals, so one shuffle does and no task holds more than its share of rows. Stored. chunks should be cheap to count.
    """
    each = [*keys, "year", "document_id"]
    once = spread(chunks.select(*each), "document_id").groupBy(*each).agg(F.count(F.lit(1)).alias("f"))
    own = Window.partitionBy(*totals, "document_id").orderBy("year")
    first = F.row_number().over(own) == 1
    first_in_year = first | ~F.lag("year").over(own).eqNullSafe(F.col("year"))
    marked = once.select(*each, "f", first.alias("_t"), first_in_year.alias("_y"))
    known = F.col("document_id").isNotNull()
    return stored(marked.groupBy(*keys, "year").agg(F.count_if(known).alias("d"), F.sum("f").alias("f"), F.count_if(known & F.col("_y")).alias("d_year"), F.count_if(known & F.col("_t")).alias("d_total")))


def years_of(df: DataFrame) -> DataFrame:
    """Every year from the first to the last: a few rows."""
    ends = df.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where(F.col("lo").isNotNull())
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("year"))


def dense(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each key and year, absent values 0. The years are broadcast; the keys are not."""
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(years_of(df)))
    return grid.join(df, [*keys, "year"], "left").fillna(0, values)


def prevalence(chunks: DataFrame, topic_keys: list[str], denominator_keys: list[str]) -> DataFrame:
    """Share of the documents of denominator_keys and year that have the topic, 0 without documents."""
    counts = annual_counts(chunks, topic_keys, rows="_rows").drop("_rows")
    totals = annual_counts(chunks, denominator_keys, "annual_source_macro_document_count", "_rows").drop("_rows")
    grid = dense(counts, topic_keys, ["document_count"]).join(totals, [*denominator_keys, "year"], "left").fillna(0, ["annual_source_macro_document_count"])
    return grid.withColumn("annual_document_prevalence", F.round(safe_share(F.col("document_count"), F.col("annual_source_macro_document_count")), 6))


def correlation_value(prevalence_column: str = "annual_document_prevalence", denominator: str = "annual_source_macro_document_count") -> Column:
    """NULL, not 0, where there are no documents to share."""
    return F.when(F.col(denominator) > 0, F.col(prevalence_column))


def series_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """First active year, peak year (highest share, then count, then the earlier), active years and total of each series."""
    active = F.col("document_count") > 0
    best = F.max(F.when(active, F.struct(F.col("annual_document_prevalence").alias("p"), F.col("document_count").alias("n"), (-F.col("year")).alias("y"))))
    out = series.groupBy(*keys).agg(F.min(F.when(active, F.col("year"))).alias("first_active_year"), best.alias("_best"), F.count_if(active).alias("active_year_count"), F.sum("document_count").alias("total_document_count"))
    return out.select(*keys, "first_active_year", (-F.col("_best.y")).alias("peak_year"), "active_year_count", "total_document_count", F.col("_best.p").alias("peak_prevalence"))


def indexed(series: DataFrame, keys: list[str], value: str, base_years: int = 1) -> DataFrame:
    """value / base * 100 from the base on: the first positive value, or the mean of the first few."""
    own = Window.partitionBy(*keys).orderBy("year")
    ranked = series.withColumn("_k", F.when(F.col(value) > 0, F.count_if(F.col(value) > 0).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    whole = Window.partitionBy(*keys)
    base = F.avg(F.when(F.col("_k") <= base_years, F.col(value))).over(whole)
    start = F.min(F.when(F.col(value) > 0, F.col("year"))).over(whole)
    return ranked.withColumn("base_year", start).withColumn("index_value", F.round(F.when(F.col("year") >= start, F.try_divide(F.col(value), base) * 100), 6)).drop("_k")


def lagged(left: DataFrame, right: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """x of year t beside y of year t + lag, for each lag; y NULL where there is none. A positive lag means that left leads."""
    shifted = left.select(*keys, "year", "x", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("_at", F.col("year") + F.col("lag"))
    return shifted.join(right.select(*keys, F.col("year").alias("_at"), "y"), [*keys, "_at"], "left").drop("_at")


def lag_correlation(pairs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Pearson r per keys and lag over the years where both sides are present, NULL with too few or a constant side."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return pairs.groupBy(*keys, "lag").agg(F.count_if(both).alias("n_overlap_years"), F.round(pearson("x", "y", least), 9).alias("correlation"))


def rank_correlation(pairs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Spearman r per keys and lag: Pearson r of average ranks among the years where both sides are present."""
    both = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    own = [*keys, "lag"]
    ranked = both.withColumn("rx", average_rank("x", own)).withColumn("ry", average_rank("y", own))
    return ranked.groupBy(*own).agg(F.count(F.lit(1)).alias("n_overlap_years"), F.round(pearson("rx", "ry", least), 9).alias("spearman_r"), F.round(pearson("x", "y", least), 9).alias("pearson_r"))


def best_lag(correlations: DataFrame, keys: list[str], value: str, nearest_zero: bool, margin: float = 0.05) -> DataFrame:
    """The lag with the largest absolute r, then the largest overlap; then the lowest lag, or the one nearest zero and then the positive one."""
    size = F.abs(value)
    ties = [F.abs("lag"), F.desc("lag")] if nearest_zero else [F.col("lag")]
    own = Window.partitionBy(*keys).orderBy(size.desc(), F.desc("n_overlap_years"), *ties)
    valid = correlations.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(own)).withColumn("_next", F.lead(size).over(own)).withColumn("_valid", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    best = valid.where("_k = 1")
    close = F.coalesce(F.round(size - F.col("_next"), 9) < margin, F.lit(False))
    return best.select(*keys, F.col("lag").alias("best_lag"), F.col(value).alias("best_correlation"), F.col("n_overlap_years").alias("best_overlap"), F.col("_valid").alias("valid_lags"), close.alias("close_second"))


def with_transforms(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """First differences and residuals from a line, per keys; a series of one year has its deviation from the mean."""
    own = Window.partitionBy(*keys)
    out = series.withColumn("difference", F.col(value) - F.lag(value).over(own.orderBy("year")))
    slope = F.coalesce(F.regr_slope(value, "year").over(own), F.lit(0.0))
    mean_y, mean_x = F.avg(value).over(own), F.avg("year").over(own)
    return out.withColumn("residual", F.col(value) - (mean_y + slope * (F.col("year") - mean_x)))


def windows(series: DataFrame, size: int, step: int = 1) -> DataFrame:
    """Each row once for every window of `size` years that holds it."""
    ends = series.agg(F.min("year").alias("_lo"), F.max("year").alias("_hi")).where(F.col("_hi") - F.col("_lo") + 1 >= size)
    starts = ends.select(F.explode(F.sequence("_lo", F.col("_hi") - (size - 1), F.lit(step).cast("long"))).alias("window_start"))
    return series.join(F.broadcast(starts), F.col("year").between(F.col("window_start"), F.col("window_start") + (size - 1)))


def pair_series(pairs: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """For pairs (pair_id, macro_topic, source_a, topic_a, source_b, topic_b) the years that either side has, with counts, denominators and shares.

    Where a side's source has no documents at all in a year its count is NULL, else an absent count is 0.
    """
    def side(s: str) -> tuple[DataFrame, DataFrame]:
        n = counts.select(F.col("source").alias(f"source_{s}"), "macro_topic", F.col("topic").alias(f"topic_{s}"), "year", F.col("document_count").alias(f"documents_{s}"), F.col("chunk_count").alias(f"chunks_{s}"))
        d = totals.select(F.col("source").alias(f"source_{s}"), "macro_topic", "year", F.col("document_count").alias(f"denominator_{s}"))
        return n, d

    (na, da), (nb, db) = side("a"), side("b")
    keys = ["pair_id", "macro_topic", "source_a", "topic_a", "source_b", "topic_b"]
    years_a = pairs.join(na, ["source_a", "macro_topic", "topic_a"]).select(*keys, "year")
    years_b = pairs.join(nb, ["source_b", "macro_topic", "topic_b"]).select(*keys, "year")
    out = years_a.unionByName(years_b).distinct()
    for s, n, d in (("a", na, da), ("b", nb, db)):
        out = out.join(n, [f"source_{s}", "macro_topic", f"topic_{s}", "year"], "left").join(d, [f"source_{s}", "macro_topic", "year"], "left")
        for c in (f"documents_{s}", f"chunks_{s}"):
            out = out.withColumn(c, F.when(F.col(f"denominator_{s}").isNotNull(), F.coalesce(c, F.lit(0))))
        out = out.withColumn(f"share_{s}", F.round(safe_ratio(F.col(f"documents_{s}"), F.col(f"denominator_{s}")), 6))
    return out


def exposure_growth(external: DataFrame, corporate: DataFrame, keys: list[str], span: int = 3) -> DataFrame:
    """Around the corporate first active year: external share in the years before, corporate share then and its maximum after."""
    first = corporate.where(F.col("document_count") > 0).groupBy(*keys).agg(F.min("year").alias("first_year"))
    p, gap = F.col("annual_document_prevalence"), F.col("year") - F.col("first_year")
    before = external.join(first, keys).groupBy(*keys).agg(F.sum(F.when(gap.between(-span, -1), p)).alias("_sum"), F.avg(F.when(gap.between(-span, -1), p)).alias("_mean"))
    after = corporate.join(first, keys).groupBy(*keys).agg(F.max(F.when(gap == 0, p)).alias("onset_prevalence"), F.max(F.when(gap.between(1, span), p)).alias("following_max_prevalence"))
    out = first.join(before, keys, "left").join(after, keys, "left")
    return out.select(*keys, "first_year", F.round(F.coalesce("_sum", F.lit(0.0)), 6).alias("prior_sum"), F.round(F.coalesce("_mean", F.lit(0.0)), 6).alias("prior_mean"), "onset_prevalence", "following_max_prevalence", F.round(F.col("following_max_prevalence") - F.col("onset_prevalence"), 6).alias("later_growth"))
