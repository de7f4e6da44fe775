"""Lists, maps and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_terms(c: Column) -> Column:
    """A list from JSON text, from text with single quotes for double ones, or from a comma list; blanks dropped."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parsed = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    bare = F.regexp_replace(text, r"^\[(.*)\]$", "$1")
    split = F.transform(F.split(bare, ","), lambda p: F.regexp_replace(F.trim(p), r"""^['"]+|['"]+$""", ""))
    return F.filter(F.transform(F.coalesce(parsed, split), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))


def stable_unique(values: Column, limit: int | None = None) -> Column:
    """Distinct values in order of first appearance, without NULLs and blanks."""
    out = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")))
    return F.slice(out, 1, limit) if limit else out


def unique_ignoring_case(values: Column, limit: int) -> Column:
    """The first spelling of each word."""
    kept = F.filter(values, lambda v, i: ~F.exists(F.slice(values, F.lit(1), i), lambda u: F.lower(u) == F.lower(v)))
    return F.slice(kept, 1, limit)


def jaccard(a: Column, b: Column) -> Column:
    """NULL where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def count_map(json_text: Column) -> Column:
    """Year to count from a JSON object, empty for bad text."""
    return F.coalesce(F.from_json(json_text, "map<string,bigint>"), F.from_json(F.lit("{}"), "map<string,bigint>"))


def at_year(counts: Column, year: Column) -> Column:
    return F.coalesce(F.try_element_at(counts, year.cast("string")), F.lit(0))


def top_records(records: Column, field: str, k: int) -> Column:
    """The k records with the largest field, NULLs last."""
    ordered = F.array_sort(records, lambda x, y: F.when(x[field] > y[field], -1).when(x[field] < y[field], 1).when(x[field].isNull() & y[field].isNotNull(), 1).when(x[field].isNotNull() & y[field].isNull(), -1).otherwise(0))
    return F.slice(ordered, 1, k)


def ordered_join(order: Column, value: Column, separator: str, limit: int | None = None) -> Column:
    """Aggregate: distinct values in the given order, joined."""
    sorted_values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.array_join(stable_unique(sorted_values, limit), separator)


def sorted_json(value: Column) -> Column:
    """Aggregate: distinct values, sorted, as JSON."""
    return F.to_json(F.array_sort(F.collect_set(value)))
