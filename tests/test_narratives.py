"""Phases that meet in time, notes on pairs and paragraphs."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import narratives as n


@pytest.mark.parametrize("bucket", [1, 8, 100])
def test_overlaps_equal_brute_force(spark, bucket):
    draw = random.Random(bucket)
    side = lambda: [(draw.choice("xyz"), i, s := draw.randrange(-5, 60), s + draw.choice([0, 0, 3, 30, -1])) for i in range(60)]
    a, b = side(), side()
    frames = [spark.createDataFrame(rows, "g string, id int, start int, end int") for rows in (a, b)]
    got = sorted((r.g, r.id_a, r.id_b) for r in n.overlap_join(*frames, ["g"], bucket).collect())
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) <= min(x[3], y[3]) and x[2] <= x[3] and y[2] <= y[3])
    assert got == want and len(want) > 100


def test_alignment_of_phases(spark):
    pairs = spark.createDataFrame([(2000, 2004, 2000, 2004), (2001, 2002, 2000, 2004), (2000, 2004, 2001, 2001), (2000, 2004, 2003, 2009), (2003, 2009, 2000, 2004)], "start_a int, end_a int, start_b int, end_b int")
    got = [(r.phase_alignment, r.shared_years, r.share_of_shorter) for r in n.phase_alignment(pairs).collect()]
    assert got == [("same_years", 5, 1.0), ("a_within_b", 2, 1.0), ("b_within_a", 1, 1.0), ("a_begins_first", 2, 0.4), ("b_begins_first", 2, 0.4)]


def narrative(**given):
    return {c: given.get(c, "") for c in n.FIELDS}


def test_notes_and_spans(spark):
    whole = narrative(label="L", overall_summary="S", evolution_pattern="up ", phase_1_years="1990-1994", phase_1_summary="one", phase_3_years="from 1999 to 2003", phase_3_summary="three")
    cases = {
        0: (whole, {**whole, "overall_summary": " "}),
        1: (whole, {**whole, "evolution_pattern": " up"}),
        2: (whole, {**whole, "evolution_pattern": "down", "evidence_note": "very SPARSE here"}),
        3: (whole, {**whole, "evolution_pattern": "down", "phase_1_years": "2001", "phase_3_years": "no year"}),
    }
    fields = ", ".join(f"{c} string" for c in ("id", *n.FIELDS))
    told = spark.createDataFrame([(f"{k}{s}", *pair[i].values()) for k, pair in cases.items() for i, s in enumerate("ab")], fields)
    pairs = spark.createDataFrame([(k, f"{k}a", f"{k}b") for k in cases] + [(9, "0a", "missing")], "k int, id_a string, id_b string")
    joined = n.attach_narratives(pairs, told, {"_a": ["id_a"], "_b": ["id_b"]})
    rows = {r.k: r for r in n.enriched_pairs(joined, only_ready=False).collect()}
    assert {k: r.narrative_alignment_note for k, r in rows.items()} == {**dict(enumerate(n.NOTES)), 9: n.NOTES[0]}
    assert (rows[1].source_a_first_phase_start, rows[1].source_a_last_phase_end, rows[1].narrative_time_span_overlap) == (1990, 2003, 14)
    assert (rows[3].source_b_first_phase_start, rows[3].narrative_time_span_overlap) == (2001, 1) and rows[9].narrative_time_span_overlap == 0
    assert sorted(r.k for r in n.enriched_pairs(joined).collect()) == [1, 2, 3]


def test_short_text_and_phases(spark):
    cut = lambda text, most: spark.range(1).select(n.short_text(F.lit(text), most)).first()[0]
    assert cut(" a  bc def ", 20) == "a bc def" and cut("alpha beta gamma", 12) == "alpha beta..." and cut("alphabetagamma", 5) == "alpha..." and cut(None, 5) == ""
    row = spark.createDataFrame([tuple(narrative(phase_1_summary="x", phase_2_years="2001").values())], ", ".join(f"{c} string" for c in n.FIELDS))
    assert row.select(n.phases_compact(100)).first()[0] == "Phase 1 (years not specified): x\nPhase 2 (2001): "


def test_paragraph_without_numbers(spark):
    fields = {**{f"{c}_a": v for c, v in narrative().items()}, **{f"{c}_b": v for c, v in narrative(label="Own").items()}, "external_source": "media"}
    row = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{c} string" for c in fields))
    row = row.selectExpr("*", "CAST(NULL AS int) AS best_lag", "-0.5D AS best_spearman_r", "CAST(NULL AS double) AS best_spearman_q_table", "CAST(NULL AS string) AS temporal_relation_label", "CAST(NULL AS int) AS first_active_year_gap", "3 AS peak_year_gap")
    said = n.individual_comparisons(row).first().comparison_paragraph
    assert "a synchronous or ambiguous relation, with a negative association" in said and "at lag not available (no valid lag), with r=-0.500 and table-level q=not available" in said
    assert "no external phase description available" in said and "gap is not available year(s) and the peak-year gap is 3 year(s)" in said
    assert n.individual_comparisons(row.withColumn("best_spearman_r", F.lit(None).cast("double"))).count() == 0
