"""Answers of language models as JSON text, under any of the keys that models choose, to one set of fields.

An answer is parsed once, in Arrow batches: as one built-in expression, with a branch for every key and place, it grew
beyond a driver's 3 GB while it was planned. An object or a list where a plain value is asked for becomes the text that Python
writes for it.
NULL and bad JSON count as an answer without keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NULLISH

# Where the fields of an answer may stand, in the order in which they are looked for.
LABEL_KEYS = ["topic_label_refined", "topic_name_raw", "title", "topic", "Topic", "subgroup", "subgroup_name", "theme_name"]
SUMMARY_KEYS = ["overall_summary", "summary", "period_overview", "historical_evolution", "historical_summary", "historical_trend", "narrative_summary", "subgroup_description", "subgroup_details", "description", "trend_summary", "context", "evolutionary_description", "analysis_summary", "Trend_Description", "Summary", "scope", "dominant_topic", "overall_theme", "timeline_summary.period_overview", "synthesis.summary", "conclusion"]
PATTERN_KEYS = ["evolution_pattern", "timeline_description", "synthesis.trend_analysis", "concept_evolution.process_description"]
EVIDENCE_KEYS = ["key_themes", "key_trends", "key_drivers", "challenges", "impact_areas", "predictive_focus_areas", "focus_areas", "major_themes", "Major Trends", "themes"]
THEME_KEYS = ["focus_areas", "key_trends", "themes", "Keywords", "keywords"]
PHASE_LIST_KEYS = ["steps", "phase_breakdown", "phases", "stages", "subgroup_history", "history", "evidence", "themes", "Key_Phases", "key_milestone_years", "chronological_evolution", "timeline_summary"]
PHASE_NESTED_KEYS = ["Timeline", "timeline_overview", "key_themes_timeline", "evolution_of_focus", "analysis.key_policy_shifts", "thematic_evolution.key_milestone_years", "key_milestone_years", "chronological_evolution"]
ITEM_YEARS_KEYS = ["years", "Years", "timeframe", "period", "Period", "Time_Period", "range", "date", "year_range", "year_group"]
ITEM_TITLE_KEYS = ["step_name", "phase", "stage_name", "title", "Topic", "Phase_Name", "name", "theme_name", "theme"]
ITEM_TEXT_KEYS = ["description", "characteristics", "summary", "Summary", "details", "focus", "Primary_Concerns", "concepts", "narrative"]
ITEM_KEYWORDS_KEYS = ["keywords", "Keywords", "key_concepts", "themes"]
PHASES = 4
# What a record says of the topic that was asked about; of these an answer may repeat only the last two.
IDENTITY = ["subgroup", "source", "assigned_label", "micro_topic_id", "topic_name_original"]
#: Fields that a default may fill where no key of the answer does.
DEFAULTED = ["topic_label_refined", "overall_summary", "evolution_pattern", "evidence_note"]
FIELDS = ["topic_label_refined", "overall_summary", "evolution_pattern", "evidence_note", *[f"phase_{i}_{part}" for i in range(1, PHASES + 1) for part in ("years", "summary")]]

_YEARS = re.compile(r"\d{4}(?:\s*[-–]\s*\d{4})?")
_NUMBER = re.compile(r"[+-]?\d+")
_Phase = tuple[str, str]


def plain(value: object) -> str:
    """A value as text with single spaces, '' where it says nothing; a list or object as Python writes it."""
    text = "" if value is None else " ".join(str(value).split())
    return "" if text.lower() in NULLISH else text


def at(answer: object, key: str) -> object:
    """The value at a key, or at the key of an object: 'synthesis.summary'."""
    for part in key.split("."):
        answer = answer.get(part) if isinstance(answer, dict) else None
    return answer


def first_at(answer: dict, keys: list[str], show=plain) -> str:
    return next(filter(None, (show(at(answer, k)) for k in keys)), "")


def listed(value: object) -> str:
    """A list as 'a; b', an object as 'k: v; l: w', anything else as it is."""
    if isinstance(value, dict):
        parts: Iterable[str] = (": ".join(filter(None, (plain(k), plain(v)))) for k, v in value.items())
    elif isinstance(value, list):
        parts = map(plain, value)
    else:
        return plain(value)
    return "; ".join(filter(None, parts))


def phase_text(item: dict) -> str:
    """'title: text | Keywords: ...'; two parts alone are joined by a colon."""
    words = listed(next((item[k] for k in ITEM_KEYWORDS_KEYS if item.get(k)), None))
    parts = [p for p in (first_at(item, ITEM_TITLE_KEYS), first_at(item, ITEM_TEXT_KEYS), words and f"Keywords: {words}") if p]
    return " | ".join([": ".join(parts[:2]), *parts[2:]])


def _year(value: object) -> int | None:
    if isinstance(value, (int, float)):
        return int(value) if value == value and abs(value) != float("inf") else None
    return int(value) if isinstance(value, str) and _NUMBER.fullmatch(value.strip()) else None


def _span(holder: object) -> str:
    first, last = (_year(at(holder, k)) for k in ("earliest_year", "latest_year"))
    if first is None:
        return ""
    return str(first) if last in (None, first) else f"{first}-{last}"


def phase_years(item: dict, default: str) -> str:
    """The years of a phase: as they are said, from its ends, its one year, the ends of its timeline, else the default."""
    said = first_at(item, ITEM_YEARS_KEYS) or _span(item)
    one = next((y for y in (_year(item.get("year")), _year(item.get("Year"))) if y is not None), None)
    return said or ("" if one is None else str(one)) or _span(item.get("timeline")) or default


def _of_list(place: object, default: str, loose: bool = False) -> list[_Phase]:
    """Phases out of a list of objects; loose: its other values are phases too."""
    found = []
    for item in place if isinstance(place, list) else ():
        if isinstance(item, dict):
            found.append((phase_years(item, default), phase_text(item)))
        elif loose:
            found.append((default, listed(item)))
    return [p for p in found if any(p)]


def _of_object(place: object, default: str, only_years: bool = False) -> list[_Phase]:
    """Phases out of an object whose keys are years."""
    found = []
    for key, value in place.items() if isinstance(place, dict) else ():
        if not only_years or _YEARS.fullmatch(plain(key)):
            own = phase_text(value) if isinstance(value, dict) else ""
            found.append((plain(key) or default, own or listed(value)))
    return [p for p in found if any(p)]


def _places(answer: dict, default: str) -> Iterator[list[_Phase]]:
    for key in PHASE_LIST_KEYS:
        yield _of_list(answer.get(key), default)
    timeline = answer.get("timeline")
    yield _of_object(timeline, default) or _of_list(timeline, default, loose=True)
    for key in PHASE_NESTED_KEYS:
        yield _of_list(at(answer, key), default) or _of_object(at(answer, key), default)
    yield _of_object(answer, default, only_years=True)
    if fourth := plain(answer.get("phase_4")):
        yield [(default, fourth)]


def phases(answer: dict, default: str) -> list[_Phase]:
    """The phases, as (years, text), of the first place that has any."""
    return next(filter(None, _places(answer, default)), [])


def name_as_label(name: object) -> str:
    """A topic's own name without its number, words capitalised."""
    text = re.sub(r"^-*\d+_", "", plain(name))
    return " ".join(re.sub(r"[_-]", " ", text).split()).title()


def fields_of(answer: dict, topic_name: str, default_years: str, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """The FIELDS of an answer. What neither a key nor a default fills comes from what there is: the label from the topic's
    name, the summary from themes, then phases; without a whole phase the summary is the first one."""
    given = {f: plain((defaults or {}).get(f)) for f in DEFAULTED}
    name, default = plain(topic_name), plain(default_years)
    found = [*phases(answer, default), *[("", "")] * PHASES]
    own = [(plain(answer.get(f"phase_{i}_years")) or years, plain(answer.get(f"phase_{i}_summary")) or text) for i, (years, text) in enumerate(found[:PHASES], 1)]
    texts = [text for _, text in own if text]
    summary = first_at(answer, SUMMARY_KEYS) or given["overall_summary"]
    if not summary and (themes := first_at(answer, THEME_KEYS, listed)):
        summary = f"Temporal synthesis centers on: {themes}."
    if not summary and texts:
        summary = "Temporal synthesis based on available phase evidence: " + " ".join(texts[:2])
    if summary and not any(years and text for years, text in own):
        own[0] = (own[0][0] or default or "full period", own[0][1] or summary)
    titles = [text.split(":", 1)[0][:80] for _, text in own if text]
    pattern = first_at(answer, PATTERN_KEYS) or given["evolution_pattern"] or (" -> ".join(titles) if len(titles) > 1 else "Single phase observation" if titles else "")
    label = first_at(answer, LABEL_KEYS) or given["topic_label_refined"] or name_as_label(plain(answer.get("topic_name_original")) or name)
    evidence = plain(answer.get("evidence_note")) or first_at(answer, EVIDENCE_KEYS, listed) or given["evidence_note"]
    return dict(zip(FIELDS, [label, plain(summary), plain(pattern), evidence, *[value for pair in own for value in pair]], strict=True))


def _parsed(text: object) -> dict:
    try:
        answer = json.loads(text) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        answer = None
    return answer if isinstance(answer, dict) else {}


def _rows(answers: pd.Series, names: pd.Series, years: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fields_of(_parsed(a), n, y) for a, n, y in zip(answers, names, years, strict=True)], columns=FIELDS)


def canonical(answer: Column, topic_name: Column, default_years: Column) -> Column:
    """A struct of FIELDS out of an answer's JSON text; every field is text, '' where there is nothing."""
    return F.pandas_udf(_rows, ", ".join(f"{f} string" for f in FIELDS))(answer, topic_name, default_years)


def whole(value: object) -> int | None:
    """A whole number, or text or a number that is one when its fraction is cut off; else None."""
    try:
        return int(float(value)) if value is not None and not isinstance(value, bool) else None
    except (TypeError, ValueError, OverflowError):
        return None


def record_of(answer: dict, defaults: dict[str, object]) -> dict[str, object]:
    """IDENTITY and FIELDS. Where a topic comes from is what was asked about, whatever the answer says; its number and name
    are the answer's own, if it has any. A number that neither has is 0."""
    name = plain(answer.get("topic_name_original")) or plain(defaults.get("topic_name_original"))
    number = whole(answer.get("micro_topic_id"))
    number = whole(defaults.get("micro_topic_id")) if number is None else number
    own = {f: plain(defaults.get(f)) for f in ("subgroup", "source", "assigned_label")}
    return {**own, "micro_topic_id": number or 0, "topic_name_original": name, **fields_of(answer, name, defaults.get("default_year_span"), defaults)}


def canonical_record(answer: Column, defaults: dict[str, Column]) -> Column:
    """A struct of IDENTITY and FIELDS out of an answer's JSON text.

    defaults: columns for any of IDENTITY, DEFAULTED and default_year_span. A NULL default is none.
    """
    names = list(defaults)

    def rows(answers: pd.Series, given: pd.DataFrame) -> pd.DataFrame:
        records = given.astype(object).where(given.notna(), None).to_dict("records")
        return pd.DataFrame([record_of(_parsed(a), d) for a, d in zip(answers, records, strict=True)], columns=[*IDENTITY, *FIELDS])

    schema = ", ".join(f"{f} {'long' if f == 'micro_topic_id' else 'string'}" for f in (*IDENTITY, *FIELDS))
    packed = F.struct(*[defaults[n].alias(n) for n in names]) if names else F.struct(F.lit(None).cast("string").alias("none"))
    typed = F.pandas_udf(rows, schema)
    return typed(answer, packed)
