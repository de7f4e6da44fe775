"""Answers under other keys, with phases in lists, objects and by year."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import payloads


@pytest.fixture(scope="module")
def canonical(spark):
    def run(*answers, name="03_green-bond_market", years="2000-2025"):
        rows = [(i, a if isinstance(a, str) or a is None else json.dumps(a)) for i, a in enumerate(answers)]
        df = spark.createDataFrame(rows, "i int, p string")
        return [r.asDict() for r in df.select("i", payloads.canonical(F.col("p"), F.lit(name), F.lit(years)).alias("c")).select("i", "c.*").orderBy("i").collect()]

    return run


def test_keys_in_order_and_nullish(canonical):
    (one,) = canonical({"overall_summary": "None", "synthesis": {"summary": " deep  text ", "trend_analysis": "up"}, "topic_label_refined": "n/a", "Topic": "Bonds", "key_themes": ["a", "null", "b"], "phase_2_years": "2010", "phase_2_summary": "two"})
    assert (one["topic_label_refined"], one["overall_summary"], one["evolution_pattern"], one["evidence_note"]) == ("Bonds", "deep text", "up", "a; b")
    assert (one["phase_1_years"], one["phase_1_summary"], one["phase_2_years"], one["phase_2_summary"]) == ("", "", "2010", "two")


def test_phases_from_lists(canonical):
    steps = {"summary": "s", "steps": ["no object", {"period": "2001-2004", "title": "Start", "description": "first", "keywords": ["x", "y"]}, {"earliest_year": 2005, "latest_year": "2005", "theme": "Mid"}, {"Year": 2009, "focus": "late"}]}
    (one,) = canonical(steps)
    assert [one[f"phase_{i}_years"] for i in (1, 2, 3, 4)] == ["2001-2004", "2005", "2009", ""]
    assert [one[f"phase_{i}_summary"] for i in (1, 2, 3)] == ["Start: first | Keywords: x; y", "Mid", "late"]
    assert one["evolution_pattern"] == "Start -> Mid -> late"


def test_phases_from_objects_and_years(canonical):
    timeline, nested, years, loose = canonical(
        {"timeline": {"2001": "begin", "2002-2004": {"name": "more"}}},
        {"analysis": {"key_policy_shifts": [{"years": "1999", "details": "law"}]}},
        {"2003": ["a", "b"], "other": 1, "2004-2006": {"k": "v"}},
        {"timeline": ["plain", {"year": "2010", "name": "n"}]},
    )
    assert [(timeline[f"phase_{i}_years"], timeline[f"phase_{i}_summary"]) for i in (1, 2)] == [("2001", "begin"), ("2002-2004", "more")]
    assert timeline["overall_summary"] == "Temporal synthesis based on available phase evidence: begin more"
    assert (nested["phase_1_years"], nested["phase_1_summary"], nested["evolution_pattern"]) == ("1999", "law", "Single phase observation")
    assert [(years[f"phase_{i}_years"], years[f"phase_{i}_summary"]) for i in (1, 2)] == [("2003", "a; b"), ("2004-2006", "k: v")]
    assert [(loose[f"phase_{i}_years"], loose[f"phase_{i}_summary"]) for i in (1, 2)] == [("2000-2025", "plain"), ("2010", "n")]


def test_fallbacks(canonical):
    themes, bad, none, empty, fourth = canonical({"focus_areas": ["p", "q"]}, "not json", None, {}, {"phase_4": "end", "conclusion": "c"})
    assert themes["overall_summary"] == "Temporal synthesis centers on: p; q."
    assert (themes["phase_1_years"], themes["phase_1_summary"]) == ("2000-2025", "Temporal synthesis centers on: p; q.")
    assert bad["topic_label_refined"] == none["topic_label_refined"] == empty["topic_label_refined"] == "Green Bond Market"
    assert all(r["overall_summary"] == r["phase_1_years"] == r["evolution_pattern"] == "" for r in (bad, none, empty))
    assert (fourth["phase_1_years"], fourth["phase_1_summary"], fourth["overall_summary"]) == ("2000-2025", "end", "c")
