"""Tables behind a report: how topics evolve, anchors with what is aligned to them, who leads, curated pairs to plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import join_bounded
from .narratives import is_ready, phase_rows, phases_compact
from .relations import unstable


def evolution(narratives: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """A row per topic: whether its narrative is whole, its phases, its years with their documents as JSON, and its peak (of equal years the first)."""
    years = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", F.col("document_count").alias("documents")))).alias("_y"), F.max(F.struct("document_count", (-F.col("year")).alias("_n"))).alias("_p"), F.sum("document_count").alias("document_years"))
    phases = phase_rows(narratives, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("dated_phases"))
    rows = narratives.join(years, keys, "left").join(phases, keys, "left").fillna(0, ["dated_phases", "document_years"])
    return rows.select(*keys, is_ready().alias("is_narrative_ready"), "evolution_pattern", "dated_phases", phases_compact(220).alias("phases_compact"), "document_years", F.coalesce(-F.col("_p._n"), F.lit(0)).alias("peak_year"), F.coalesce(F.to_json("_y"), F.lit("[]")).alias("annual_counts_json"))


def evolution_sources(evolved: DataFrame, groups: list[str]) -> DataFrame:
    """Topics, whole narratives, phases and patterns per group."""
    pattern = lambda p: F.count_if(F.col("evolution_pattern") == p).alias(f"{p}_topics")
    return evolved.groupBy(*groups).agg(F.count(F.lit(1)).alias("topic_count"), F.count_if("is_narrative_ready").alias("ready_count"), F.round(F.avg("dated_phases"), 6).alias("mean_dated_phases"), F.sum("document_years").alias("document_years"), *[pattern(p) for p in ("growing", "declining", "steady")])


def anchors_with_aggregates(anchors: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors with the topics and documents of each source that are aligned with them, 0 where there are none.

    aligned: keys, source (academic or media), n_documents. note says which sources an anchor lacks.
    """
    of = lambda s, f: F.coalesce(f(F.when(F.col("source") == s, F.col("n_documents"))), F.lit(0))
    sums = aligned.groupBy(*keys).agg(*[of(s, F.count).alias(f"{s}_topic_count") for s in ("academic", "media")], *[of(s, F.sum).alias(f"{s}_document_count") for s in ("academic", "media")])
    columns = [f"{s}_{c}_count" for s in ("academic", "media") for c in ("topic", "document")]
    rows = join_bounded(anchors, sums, keys, "left").fillna(0, columns)
    lacking = F.array_join(F.filter(F.array(*[F.when(F.col(f"{s}_topic_count") == 0, s) for s in ("academic", "media")]), lambda s: s.isNotNull()), ", ")
    return rows.withColumn("note", F.when(lacking == "", "aligned with both sources").otherwise(F.concat(F.lit("no aligned topic of: "), lacking)))


def precedence_counts(classed: DataFrame, groups: list[str]) -> DataFrame:
    """Pairs per group and class of precedence, of all and of those with a stable best lag, and their shares of the group."""
    stable = ~F.coalesce(unstable(F.col("valid_lags"), F.col("close_second")), F.lit(True))
    counts = classed.groupBy(*groups, "precedence_class").agg(F.count(F.lit(1)).alias("pair_count"), F.count_if(stable).alias("stable_pair_count"))
    whole = classed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_all"), F.count_if(stable).alias("_stable"))
    rows = counts.join(whole, groups)
    return rows.withColumns({"share_of_pairs": F.round(F.col("pair_count") / F.col("_all"), 6), "share_of_stable": F.round(F.coalesce(F.try_divide(F.col("stable_pair_count"), F.col("_stable")), F.lit(0.0)), 6)}).drop("_all", "_stable")


def curated_series(series: DataFrame, chosen: DataFrame, pair: str) -> DataFrame:
    """The chosen pairs' series in long form: pair, year, side (a or b), share, and the share by the side's largest, to plot both on one axis.

    chosen: the pair column and any others, which are kept. A side without a share above 0 has NULL for the latter.
    """
    rows = join_bounded(series, chosen, [pair])
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"share_{s}").alias("share")) for s in ("a", "b")])).alias("_s")
    kept = [c for c in chosen.columns if c != pair]
    long = rows.select(pair, *kept, "year", sides).select(pair, *kept, "year", "_s.side", "_s.share")
    top = long.groupBy(pair, "side").agg(F.max("share").alias("_top"))
    return long.join(top, [pair, "side"]).withColumn("scaled_share", F.round(F.when(F.col("_top") > 0, F.col("share") / F.col("_top")), 6)).drop("_top")
