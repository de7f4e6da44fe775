"""Numeric expressions and the labels made from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit sectors and their industries.
SECTORS = {"01": "agriculture_crops", "02": "agriculture_livestock", "10": "metal_mining", "13": "oil_gas", "20": "food_manufacturing"}


def number(c: Column) -> Column:
    """A double, NULL for what is none and for NaN."""
    value = c.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(c: Column) -> Column:
    return number(c).cast("long")


def safe_ratio(a: Column, b: Column) -> Column:
    """NULL where either is NULL or the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_share(a: Column, b: Column) -> Column:
    """0 where there is no ratio."""
    return F.coalesce(safe_ratio(a, b), F.lit(0.0))


def sector(code: Column) -> Column:
    """An industry code without its last two digits, of two digits at least."""
    digits = F.floor(whole(code) / 100).cast("string")
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def industry(two_digits: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SECTORS.items() for x in pair]), two_digits)


def least_topic_size(rows: Column) -> Column:
    """A fiftieth of the rows, half to even, between 5 and 50."""
    return F.greatest(F.lit(5), F.least(F.lit(50), F.bround(rows * 0.02).cast("int")))


def axis_top(c: Column, step: float = 0.05) -> Column:
    return F.ceil(c / step) * step


def overlap_years(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)


def phase_years(c: Column) -> Column:
    """First two four-digit groups of a text as (start, end); one alone is both."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9]{4})"), F.lit(1)), lambda y: y.cast("int"))
    first = F.get(found, 0)
    return F.when(first.isNotNull(), F.struct(first.alias("start"), F.coalesce(F.get(found, 1), first).alias("end")))


def strict_phase_years(c: Column) -> Column:
    """Only 'a-b' or a single year, nothing else around."""
    text = F.trim(F.coalesce(c, F.lit("")))
    a, b = (F.regexp_extract(text, r"^([0-9]{4})(?:\s*[-–]\s*([0-9]{4}))?$", k) for k in (1, 2))
    start = F.nullif(a, F.lit("")).cast("int")
    return F.when(start.isNotNull(), F.struct(start.alias("start"), F.coalesce(F.nullif(b, F.lit("")).cast("int"), start).alias("end")))


def relation_strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(r.isNull(), "not_available").when(size >= 0.70, "strong").when(size >= 0.50, "moderate").when(size >= 0.30, "weak").otherwise("very_weak")


def relation_direction(r: Column) -> Column:
    return F.when(r.isNull(), "not_available").when(r > 0, "same_direction").when(r < 0, "opposite_direction").otherwise("no_monotonic_association")


def significance(q: Column) -> Column:
    return F.when(q < 0.05, "q_lt_0_05").when(q < 0.10, "q_lt_0_10").otherwise("not_significant")


def peak_label(gap: Column) -> Column:
    return F.when(gap > 0, "external_peaks_before_corporate").when(gap < 0, "corporate_peaks_before_external").when(gap == 0, "synchronous_peak").otherwise("insufficient_peak_data")


def peak_window_label(gap: Column) -> Column:
    near = F.when(F.abs(gap) <= 1, "near_synchronous_peak_abs_le_1_year")
    return near.when(gap >= 2, "external_peaks_before_corporate_2plus_years").when(gap <= -2, "corporate_peaks_before_external_2plus_years").otherwise("insufficient_peak_data")


def onset_label(gap: Column) -> Column:
    return F.when(gap > 0, "external_active_before_corporate").when(gap < 0, "corporate_active_before_external").when(gap == 0, "same_first_active_year").otherwise("insufficient_onset_data")


def combined_pattern(gap: Column, r: Column) -> Column:
    """Whose peak comes first, and whether the series move together."""
    def by_sign(same: str, opposite: str, none: str) -> Column:
        return F.when(r > 0, same).when(r < 0, opposite).otherwise(none)

    near = by_sign("near_synchronous_peak_same_direction", "near_synchronous_peak_opposite_direction", "near_synchronous_peak_no_direction")
    external = by_sign("external_prior_peak_same_direction", "external_prior_peak_inverse_trajectories", "external_prior_peak_no_monotonic_direction")
    corporate = by_sign("corporate_prior_peak_same_direction", "corporate_prior_peak_inverse_trajectories", "corporate_prior_peak_no_monotonic_direction")
    return F.when(gap.isNull() | r.isNull(), "insufficient_data").when(F.abs(gap) <= 1, near).when(gap >= 2, external).otherwise(corporate)


def exposure_pattern(prior_sum: Column, growth: Column) -> Column:
    grown, before = growth > 0, prior_sum > 0
    return (
        F.when(growth.isNull(), "insufficient_later_growth_window")
        .when(before & grown, "external_prior_exposure_with_later_corporate_growth")
        .when(before, "external_prior_exposure_without_later_corporate_growth")
        .when(grown, "corporate_growth_without_prior_external_exposure")
        .otherwise("no_prior_external_exposure_no_later_corporate_growth")
    )


def coverage_label(ratio: Column, unpaired: Column) -> Column:
    """Coverage of anchors, cut at 0.99, 0.70 and 0.50."""
    return (
        F.when((ratio >= 0.99) & (unpaired >= 5), "broad anchor set with substantial external spillovers")
        .when(ratio >= 0.99, "broad coverage with residual external gaps")
        .when(ratio >= 0.70, "partial but substantive coverage")
        .when(ratio >= 0.50, "partial coverage with notable external spillovers")
        .otherwise("selective coverage concentrated in a few corporate anchors")
    )


def package_coverage_label(ratio: Column, aligned: Column, unpaired: Column) -> Column:
    """The other rule set: cut at 0.8 and 0.5, spillovers relative to what is aligned."""
    many = unpaired >= F.greatest(F.lit(3), F.floor(aligned / 2))
    return (
        F.when((ratio >= 0.8) & (unpaired == 0), "broad corporate coverage")
        .when((ratio >= 0.8) & many, "broad anchor set with substantial external spillovers")
        .when(ratio >= 0.8, "broad coverage with residual external gaps")
        .when((ratio >= 0.5) & many, "partial coverage with notable external spillovers")
        .when(ratio >= 0.5, "partial but substantive coverage")
        .otherwise("selective coverage concentrated in a few corporate anchors")
    )


def alignment_type(academic: Column, media: Column) -> Column:
    both = (academic > 0) & (media > 0)
    return (
        F.when(both & (academic >= media * 2), "academic-dominated aligned set with a limited media layer")
        .when(both, "mixed academic-media aligned set")
        .when(academic > 0, "academic-only aligned set")
        .when(media > 0, "media-only aligned set")
        .otherwise("no aligned external set")
    )


def strategic_implication(ratio: Column, unpaired: Column) -> Column:
    return (
        F.when((unpaired >= 5) & (ratio < 0.99), "External discourse exceeds what corporate discourse absorbs, indicating a visible blind-spot problem.")
        .when(unpaired > 0, "Corporate discourse covers the core of this domain while leaving some external strands outside its frame.")
        .when(ratio >= 0.70, "Corporate disclosure incorporates most retained external signals in this domain.")
        .otherwise("Corporate disclosure remains concentrated in a limited subset of possible anchors.")
    )
