"""Sentences for readers out of numbers. The wording is fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels in the order in which ties are decided, as a phrase and as a short one.
LEADERS = {
    "academic_leads_corporate": ("Academic discourse appears to lead corporate discourse", "academic-leading"),
    "media_leads_corporate": ("Media discourse appears to lead corporate discourse", "media-leading"),
    "corporate_leads_academic": ("Corporate discourse appears to lead academic discourse", "corporate-leading-academic"),
    "corporate_leads_media": ("Corporate discourse appears to lead media discourse", "corporate-leading-media"),
}
UNCLEAR = "synchronous_or_unclear"


def decimals3(c: Column) -> Column:
    """Three decimals, halves to even, zero without a sign."""
    return F.replace(F.format_number(c + F.lit(0.0), 3), F.lit(","), F.lit(""))


def significant3(c: Column) -> Column:
    """Three significant digits of a number from 0 to below 1000, without zeros at the end; below 0.0001 with an exponent."""
    digits = F.when(c < 0.001, F.format_number(c, 6)).when(c < 0.01, F.format_number(c, 5)).when(c < 0.1, F.format_number(c, 4)).when(c < 1, F.format_number(c, 3)).when(c < 10, F.format_number(c, 2)).when(c < 100, F.format_number(c, 1)).otherwise(F.format_number(c, 0))
    tiny = F.regexp_replace(F.regexp_replace(F.format_string("%.2e", c.cast("double")), r"0+e", "e"), r"\.e", "e")
    short = F.when(digits.contains("."), F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")).otherwise(digits)
    return F.when(c == 0, "0").when(c < 0.0001, tiny).otherwise(short)


def peak_sentence(corporate: Column, external: Column, source: Column, gap: Column, r: Column, q: Column) -> Column:
    """What the gap of two peaks says (positive: the external one is earlier), and whether the series move together."""
    years = F.abs(gap).cast("int").cast("string")
    timing = (
        F.when(gap > 1, F.concat(F.lit("the "), source, F.lit(" counterpart peaks "), years, F.lit(" years before the corporate anchor. This is consistent with an external issue becoming salient before later corporate disclosure attention")))
        .when(gap == 1, F.concat(F.lit("the "), source, F.lit(" counterpart peaks one year before the corporate anchor. This indicates a near-synchronous pattern with slight external precedence")))
        .when(gap == 0, "both series peak in the same year, indicating synchronous maximum salience")
        .when(gap == -1, "the corporate anchor peaks one year before the external counterpart. This indicates a near-synchronous pattern with slight corporate precedence")
        .otherwise(F.concat(F.lit("the corporate anchor peaks "), years, F.lit(" years before the "), source, F.lit(" counterpart. This is consistent with corporate salience preceding the external maximum")))
    )
    numbers = F.concat(F.lit("(rho="), decimals3(r), F.lit(", q="), F.coalesce(significant3(q), F.lit("not available")), F.lit(")"))
    together = (
        F.when(r.isNull(), "The same-year Spearman association is not available.")
        .when(r < 0, F.concat(F.lit("The same-year Spearman association is negative "), F.replace(numbers, F.lit(")"), F.lit("), ")), F.lit("so the peak result should be read as a timing contrast rather than contemporaneous co-movement.")))
        .when(r > 0, F.concat(F.lit("The same-year Spearman association is positive "), F.replace(numbers, F.lit(")"), F.lit("), ")), F.lit("so the peak result complements a pattern of contemporaneous co-movement.")))
        .otherwise(F.concat(F.lit("The same-year Spearman association is zero "), numbers, F.lit(".")))
    )
    missing = F.concat(F.lit('Peak timing could not be assessed for "'), corporate, F.lit('" and the '), source, F.lit(' counterpart "'), external, F.lit('" because at least one series has no active peak year.'))
    return F.when(gap.isNull(), missing).otherwise(F.concat(F.lit('For "'), corporate, F.lit('" and "'), external, F.lit('", '), timing, F.lit(". "), together))


def dominant_pattern(counts: dict[str, Column], stable: Column) -> Column:
    """Which order in time rules, by the counts of the labels; stable: how many of the leading cases are stable."""
    n = {k: F.coalesce(v, F.lit(0)) for k, v in counts.items()}
    leading = [k for k in LEADERS if k in n]
    most = F.greatest(*n.values())
    phrase = lambda i: F.coalesce(*[F.when(n[k] == most, LEADERS[k][i]) for k in leading])
    first_short = F.coalesce(*[F.when(n[k] > 0, LEADERS[k][1]) for k in leading])
    cases = F.concat(F.lit(" ("), stable.cast("string"), F.lit(" stable leading case"), F.when(stable != 1, "s").otherwise(""), F.lit(")"))
    isolated = F.concat(F.lit("Mostly synchronous/co-evolving, with isolated "), first_short, F.lit(" episodes"), F.when(stable > 0, cases).otherwise(""), F.lit("."))
    led = F.concat(phrase(0), F.when(n[UNCLEAR] > 0, ", but with residual synchronous or unclear cases.").otherwise("."))
    return F.when(most == 0, "No robust temporal signal remains after post-comment filtering.").when(phrase(0).isNotNull(), led).when(first_short.isNull(), "Mostly synchronous or inconclusive temporal ordering.").otherwise(isolated)
