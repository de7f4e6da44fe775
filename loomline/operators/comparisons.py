"""Topics of one source against those of others: relation rows, series of anchors, order of panels, columns of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from . import series
from .relational import top_by

_FACTS = ["first_active_year", "peak_year", "active_year_count", "peak_prevalence"]


def relation_rows(anchors: DataFrame, externals: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Facts of an anchor's series beside those of its external series (with external_source and external_relation_label)."""
    own = anchors.select(*keys, *[F.col(c).alias(f"corporate_{c}") for c in _FACTS])
    other = externals.select(*keys, "external_source", "external_relation_label", "external_topic_count", *[F.col(c).alias(f"external_{c}") for c in _FACTS])
    rows = other.join(own, keys)
    gap = lambda c: (F.col(f"corporate_{c}") - F.col(f"external_{c}"))
    name = F.concat_ws("::", F.lit(level), *keys, F.col("external_source") if level == "aggregate" else F.col("external_relation_label"))
    return rows.select(name.alias("relation_id"), F.lit(level).alias("relation_level"), "*", gap("first_active_year").alias("first_active_year_gap"), gap("peak_year").alias("peak_year_gap"))


def anchor_series(series_keys: DataFrame, chunks: DataFrame, keys: list[str], totals: list[str], cells: DataFrame | None = None) -> DataFrame:
    """For every series key and year: chunks, documents and their shares of all of totals, and of the year's.

    cells: document_cells of the chunks, where they are there already.
    """
    cells = series.document_cells(chunks, keys, totals) if cells is None else cells
    counts = cells.select(*keys, "year", F.col("d").alias("year_document_count"), F.col("f").alias("year_frequency"))
    by_year = cells.groupBy(*totals, "year").agg(F.sum("d_year").alias("annual_source_macro_document_count"))
    overall = cells.groupBy(*totals).agg(F.sum("d_total").alias("denominator"))
    grid = series_keys.crossJoin(F.broadcast(series.years_of(cells))).join(counts, [*keys, "year"], "left").join(by_year, [*totals, "year"], "left").join(overall, totals, "left")
    filled = grid.fillna(0, ["year_document_count", "year_frequency", "annual_source_macro_document_count", "denominator"])
    return filled.withColumn("relative_share", F.round(numbers.safe_share(F.col("year_frequency"), F.col("denominator")), 9)).withColumn("annual_document_prevalence", F.round(numbers.safe_share(F.col("year_document_count"), F.col("annual_source_macro_document_count")), 9))


def by_category(column: str, order: list[str]) -> Column:
    """A sort key: the place of a value in the given order, others last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def panel_order(rows: DataFrame, group: list[str], key: str, pinned: list[str], order: list[Column]) -> DataFrame:
    """Position of each row in its group: pinned keys first, in their order, then by the order."""
    return top_by(rows, group, [by_category(key, pinned), *order], 2**31 - 1, "position")


def match_texts(texts: DataFrame, documents: DataFrame, keys: list[str], text: str, order: list[Column]) -> DataFrame:
    """Each text with the first document of its keys that has the same text, or none."""
    first = top_by(documents, [*keys, text], order, 1)
    return texts.join(first, [*keys, text], "left")


def numbered_to_rows(df: DataFrame, keys: list[str], prefix: str, k: int) -> DataFrame:
    """Columns prefix_1..k as rows with their rank, empty ones left out."""
    values = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"{prefix}_{i}").alias("value")) for i in range(1, k + 1)])
    rows = df.select(*keys, F.explode(F.filter(values, lambda v: v["value"].isNotNull() & (v["value"] != ""))).alias("v"))
    return rows.select(*keys, "v.rank", F.col("v.value").alias(prefix))


def span(phases: list[Column]) -> Column:
    """(start, end) over parsed phases: the earliest start and the latest end, NULLs where there is none."""
    return F.struct(F.array_min(F.array(*[p["start"] for p in phases])).alias("start"), F.array_max(F.array(*[p["end"] for p in phases])).alias("end"))


def coalesce_suffixes(df: DataFrame, name: str) -> DataFrame:
    """name, name_x and name_y as one column: the first of them that is not NULL."""
    present = [c for c in (name, f"{name}_x", f"{name}_y") if c in df.columns]
    if present in ([], [name]):
        return df
    return df.withColumn(name, F.coalesce(*present)).drop(f"{name}_x", f"{name}_y")


def preferred_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns first, '' where the table has none, then the others."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in preferred], *[c for c in df.columns if c not in preferred])


def refreshed(df: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Attributes of the key as the catalogue has them now, in place of the table's own."""
    return df.drop(*[c for c in catalogue.columns if c != key]).join(catalogue, key, "left")


def with_alias(df: DataFrame, name: str, other: str) -> DataFrame:
    """name as a copy of other where the table has only that."""
    return df.withColumn(name, F.col(other)) if name not in df.columns and other in df.columns else df
