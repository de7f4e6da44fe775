"""Narratives of topics side by side: phases that meet in time, spans, notes on how they align, and paragraphs for readers.

A narrative has a label, an overall summary, an evolution pattern, a note on its evidence, and up to four phases, each
with years as text and a summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import overlap_years, phase_years
from ..functions.sentences import decimals3, significant3
from ..functions.text import clean_text
from ..operators.comparisons import span

PHASES = 4
#: Years in a bucket of the interval join.
BUCKET_YEARS = 8
# Notes on a pair, in the order in which they are decided.
NOTES = ("missing narrative on at least one side", "both sides share the same labeled evolution pattern", "at least one side reports sparse evidence", "patterns differ across the two discourse narratives")
SPARSE = "sparse"
# Phrases of the comparison paragraph.
LEADS = {"external_leads": "an apparent external lead", "corporate_leads": "an apparent corporate lead"}
NO_LEAD = "a synchronous or ambiguous relation"
NOTHING = "not available"
CAUTION = "so the relation is best read as an exploratory temporal alignment rather than causal evidence."
FIELDS = ["label", "overall_summary", "evolution_pattern", "evidence_note", *[f"phase_{i}_{c}" for i in range(1, PHASES + 1) for c in ("years", "summary")]]


def short_text(c: Column, most: int) -> Column:
    """Cut after most signs, back to a word's end, with three dots."""
    text = clean_text(c)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", "")), F.lit("...")))


def phases_compact(most: int, suffix: str = "") -> Column:
    """A line for each phase that has years or a summary."""
    lines = []
    for i in range(1, PHASES + 1):
        years, summary = clean_text(F.col(f"phase_{i}_years{suffix}")), short_text(F.col(f"phase_{i}_summary{suffix}"), most)
        line = F.concat(F.lit(f"Phase {i} ("), F.when(years == "", "years not specified").otherwise(years), F.lit("): "), summary)
        lines.append(F.when((years != "") | (summary != ""), line))
    return F.concat_ws("\n", *lines)


def is_ready(suffix: str = "") -> Column:
    """A label, a summary and at least one phase with years and a summary."""
    filled = lambda name: clean_text(F.col(f"{name}{suffix}")) != ""
    whole = [filled(f"phase_{i}_years") & filled(f"phase_{i}_summary") for i in range(1, PHASES + 1)]
    return filled("label") & filled("overall_summary") & F.array_contains(F.array(*whole), True)


def attach_narratives(pairs: DataFrame, narratives: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """The narrative fields of both sides, NULL where a side has none. keys: suffix -> the pair's columns for the narrative's key columns, which `narratives` has first."""
    own = [c for c in narratives.columns if c not in FIELDS]
    out = pairs
    for suffix, columns in keys.items():
        side = narratives.select(*[F.col(k).alias(c) for k, c in zip(own, columns, strict=True)], *[F.col(c).alias(f"{c}{suffix}") for c in FIELDS])
        out = out.join(side, columns, "left")
    return out


def alignment_note(a: str = "_a", b: str = "_b") -> Column:
    sparse = F.lower(F.coalesce(F.col(f"evidence_note{a}"), F.lit(""))).contains(SPARSE) | F.lower(F.coalesce(F.col(f"evidence_note{b}"), F.lit(""))).contains(SPARSE)
    return F.when(~(is_ready(a) & is_ready(b)), NOTES[0]).when(same_pattern(a, b), NOTES[1]).when(sparse, NOTES[2]).otherwise(NOTES[3])


def same_pattern(a: str = "_a", b: str = "_b") -> Column:
    return F.trim(F.coalesce(F.col(f"evolution_pattern{a}"), F.lit(""))) == F.trim(F.coalesce(F.col(f"evolution_pattern{b}"), F.lit("")))


def enriched_pairs(pairs: DataFrame, only_ready: bool = True) -> DataFrame:
    """Pairs with attached narratives (_a, _b): readiness, spans of their phases, years that both cover, and a note.

    A side whose phases have no year covers nothing. only_ready: just pairs with two whole narratives.
    """
    spans = {s: span([phase_years(F.col(f"phase_{i}_years_{s}")) for i in range(1, PHASES + 1)]) for s in ("a", "b")}
    out = pairs.withColumns({"both_have_narratives": is_ready("_a") & is_ready("_b"), "same_evolution_pattern": same_pattern(), "narrative_alignment_note": alignment_note(), **{f"_span_{s}": c for s, c in spans.items()}})
    for s in ("a", "b"):
        out = out.withColumn(f"source_{s}_first_phase_start", F.col(f"_span_{s}.start")).withColumn(f"source_{s}_last_phase_end", F.col(f"_span_{s}.end"))
    shared = overlap_years(*[F.col(c) for c in ("source_a_first_phase_start", "source_a_last_phase_end", "source_b_first_phase_start", "source_b_last_phase_end")])
    out = out.withColumn("narrative_time_span_overlap", F.when(F.col("_span_a.start").isNull() | F.col("_span_b.start").isNull(), 0).otherwise(shared)).drop("_span_a", "_span_b")
    return out.where("both_have_narratives") if only_ready else out


def phase_rows(narratives: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phase, start, end, summary of phases with readable years; an end before its start is the start."""
    rows = narratives.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("phase"), phase_years(F.col(f"phase_{i}_years")).alias("y"), clean_text(F.col(f"phase_{i}_summary")).alias("summary")) for i in range(1, PHASES + 1)])).alias("p"))
    return rows.where(F.col("p.y").isNotNull()).select(*keys, "p.phase", F.col("p.y.start").alias("start"), F.greatest("p.y.start", "p.y.end").alias("end"), "p.summary")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], bucket: int = BUCKET_YEARS) -> DataFrame:
    """Rows of both sides (columns start and end, suffixed _a and _b) with equal keys whose intervals share a year.

    An interval stands in every bucket of years that it touches; a pair meets in each bucket that both touch and is taken
    in the first of them, so the join is by equality and no pair comes twice. Long intervals cost a row per bucket.
    """
    def side(rows: DataFrame, s: str) -> DataFrame:
        renamed = rows.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c not in on])
        first, last = (F.floor(F.col(f"{c}_{s}") / bucket).cast("int") for c in ("start", "end"))
        return renamed.where(F.col(f"start_{s}") <= F.col(f"end_{s}")).withColumn("_bucket", F.explode(F.sequence(first, last)))

    met = side(left, "a").join(side(right, "b"), [*on, "_bucket"])
    begin = F.greatest("start_a", "start_b")
    return met.where((begin <= F.least("end_a", "end_b")) & (F.col("_bucket") == F.floor(begin / bucket))).drop("_bucket")


def phase_alignment(pairs: DataFrame) -> DataFrame:
    """Overlapping phases (overlap_join) with the years they share and how one lies to the other."""
    a, b = (F.col("start_a"), F.col("end_a")), (F.col("start_b"), F.col("end_b"))
    kind = (
        F.when((a[0] == b[0]) & (a[1] == b[1]), "same_years")
        .when((a[0] >= b[0]) & (a[1] <= b[1]), "a_within_b")
        .when((b[0] >= a[0]) & (b[1] <= a[1]), "b_within_a")
        .when(a[0] < b[0], "a_begins_first")
        .otherwise("b_begins_first")
    )
    shared = overlap_years(*a, *b)
    shorter = F.least(a[1] - a[0], b[1] - b[0]) + 1
    return pairs.withColumns({"shared_years": shared, "share_of_shorter": F.round(shared / shorter, 6), "phase_alignment": kind})


def whole_or(c: Column, otherwise: str = NOTHING) -> Column:
    return F.coalesce(c.cast("long").cast("string"), F.lit(otherwise))


def lag_phrase(lag: Column) -> Column:
    """A positive lag: the external side leads."""
    years = F.concat(F.lit(" by "), F.abs(lag).cast("int").cast("string"), F.lit(" year(s)"))
    return F.when(lag.isNull(), "no valid lag").when(lag > 0, F.concat(F.lit("external discourse leading corporate disclosure"), years)).when(lag < 0, F.concat(F.lit("corporate disclosure leading external discourse"), years)).otherwise("same-year coevolution")


def relation_phrase(label: Column, r: Column) -> Column:
    kind = F.coalesce(*[F.when(clean_text(label) == k, v) for k, v in LEADS.items()], F.lit(NO_LEAD))
    return F.concat(kind, F.lit(", with a "), F.when(r >= 0, "positive").otherwise("negative"), F.lit(" association at the selected lag"))


def comparison_paragraph(external_label: Column, external_summary: Column, external_phases: Column, corporate: str = "_b") -> Column:
    """What two narratives and the relation of their series say. The row has the corporate narrative, external_source, best_lag, best_spearman_r, best_spearman_q_table, temporal_relation_label and both gaps."""
    r, q, lag = F.col("best_spearman_r"), F.col("best_spearman_q_table"), F.col("best_lag")
    source = clean_text(F.col("external_source"))
    said = lambda c, most, none: F.coalesce(F.nullif(short_text(c, most), F.lit("")), F.lit(none))
    own_label = clean_text(F.col(f"label{corporate}"))
    return F.concat(
        F.lit('The corporate topic "'), own_label, F.lit('" and the '), source, F.lit(' counterpart "'), external_label, F.lit('" show '), relation_phrase(F.col("temporal_relation_label"), r),
        F.lit("; the strongest Spearman association is at lag "), whole_or(lag), F.lit(" ("), lag_phrase(lag), F.lit("), with r="), F.coalesce(decimals3(r), F.lit(NOTHING)), F.lit(" and table-level q="), F.coalesce(significant3(q), F.lit(NOTHING)),
        F.lit(". The corporate narrative is summarized as: "), said(F.col(f"overall_summary{corporate}"), 360, "no corporate narrative summary available"),
        F.lit(". Its period narrative highlights "), said(phases_compact(220, corporate), 360, "no corporate phase description available"),
        F.lit(". The "), source, F.lit(" narrative is summarized as: "), said(external_summary, 360, "no external narrative summary available"),
        F.lit(". Its period narrative highlights "), said(external_phases, 360, "no external phase description available"),
        F.lit(". The first-active-year gap is "), whole_or(F.col("first_active_year_gap")), F.lit(" year(s) and the peak-year gap is "), whole_or(F.col("peak_year_gap")), F.lit(" year(s), " + CAUTION),
    )


def individual_comparisons(relations: DataFrame) -> DataFrame:
    """Relations with a correlation and both narratives attached (_a external, _b corporate), with their compact phases and the paragraph."""
    rows = relations.where(F.col("best_spearman_r").isNotNull())
    return rows.withColumns({"external_phases_compact": phases_compact(220, "_a"), "corporate_phases_compact": phases_compact(220, "_b"), "comparison_paragraph": comparison_paragraph(clean_text(F.col("label_a")), F.col("overall_summary_a"), phases_compact(220, "_a"))})


def aggregate_comparisons(relations: DataFrame, components: DataFrame, narratives: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Relations of an anchor (corporate narrative as _b) with all topics of a source together: their labels, summaries and phases, the largest first.

    components: on, keys (the narrative's) and external_unique_document_count. The texts of one anchor's components are
    put together, not those of a source.
    """
    told = components.join(narratives, keys, "left")
    label = F.coalesce(F.nullif(clean_text(F.col("label")), F.lit("")), clean_text(F.col(keys[-1])))
    summary, phases = short_text(F.col("overall_summary"), 260), phases_compact(140)
    item = F.struct((-F.col("external_unique_document_count")).alias("n"), *[F.col(k).alias(k) for k in keys], label.alias("label"), F.when(summary != "", F.concat(label, F.lit(": "), summary)).alias("summary"), F.when(phases != "", F.concat(label, F.lit("\n"), phases)).alias("phases"))
    held = told.groupBy(*on).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    listed = lambda field, between: F.coalesce(F.array_join(F.filter(F.transform("_c", lambda x: x[field]), lambda x: x.isNotNull()), between), F.lit(""))
    rows = relations.where(F.col("best_spearman_r").isNotNull()).join(held, on, "left")
    rows = rows.withColumns({"external_component_labels": listed("label", "; "), "external_overall_summary": listed("summary", "\n\n"), "external_phases_compact": listed("phases", "\n\n"), "corporate_phases_compact": phases_compact(220, "_b"), "external_component_count": F.coalesce(F.size("_c"), F.lit(0))}).drop("_c")
    together = F.concat(clean_text(F.col("external_source")), F.lit(" aggregate"))
    return rows.withColumns({"external_topic_label": together, "comparison_paragraph": comparison_paragraph(together, F.col("external_overall_summary"), F.col("external_phases_compact"))})
