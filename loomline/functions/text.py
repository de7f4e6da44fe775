"""Text expressions. NULL becomes '' unless said otherwise."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\x0B\f\r]+"
# Vocabularies of the decisions and labels that people and models write.
NULLISH = ["", "none", "null", "nan", "n/a", "na"]
YES_NO = r"(?<![\p{L}\p{N}_])(yes|no|sim|nao|não)(?![\p{L}\p{N}_])"
EXCLUDED_STATUS, UNPAIRED_STATUS, ALIGNED_STATUS = "excluded", "external_relevant_unpaired", "aligned"
FUNCTION_KEYWORDS: list[tuple[str, list[str]]] = [
    ("technical_research", ["technical", "research", "scientific", "engineering", "technology_development"]),
    ("operational_management", ["operational", "operations", "management", "implementation", "project_execution"]),
    ("market_strategy", ["market", "strategy", "commercial", "consumer", "demand", "branding", "business_strategy"]),
    ("financial_investor", ["financial", "investor", "investment", "lender", "financ", "capital_market", "esg_finance"]),
    ("policy_governance", ["policy", "governance", "regulatory_design", "institutional", "public_policy"]),
    ("public_political_debate", ["public", "political", "media", "debate", "public_discourse"]),
    ("legal_compliance", ["legal", "compliance", "litigation", "regulatory_compliance", "disclosure"]),
    ("community_access_justice", ["community", "justice", "equity", "access", "livelihood", "local_population"]),
    ("environmental_risk_stewardship", ["risk", "stewardship", "environmental", "biodiversity", "restoration", "pollution"]),
    ("mixed_or_unclear", ["mixed", "unclear", "hybrid", "ambiguous"]),
]
SAME_ISSUE_KEYWORDS: list[tuple[str, list[str]]] = [
    ("same_issue", ["same_issue", "same_topic", "sameproblem", "same_problem"]),
    ("adjacent_issue", ["adjacent", "related", "overlap", "complement", "partial"]),
    ("weak_match", ["weak", "different", "distinct", "mismatch", "no"]),
]
SAME_ISSUE_SYNONYMS: list[tuple[str, list[str]]] = [("same_issue", ["yes", "true", "same", "sameissue", "strong_match", "direct_match"])]
RELATION_KEYWORDS: list[tuple[str, list[str]]] = [
    ("different_function", ["different", "complement", "contrast", "distinct", "divergent", "unrelated", "none"]),
    ("same_function", ["same", "similar", "aligned"]),
    ("unclear", ["unclear", "mixed", "partial", "unknown"]),
]
KEEP_WORDS = ["true", "yes", "1", "keep"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of the value, which is worked out once however often use names it; in branches Spark repeats it for each name."""
    return F.get(F.transform(F.array(value), use), 0)


def clean_text(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither NULL nor blank."""
    return F.coalesce(*map(blank_to_null, columns), F.lit(""))


def drop_nullish(c: Column) -> Column:
    """Words for nothing become ''."""
    text = clean_text(c)
    return F.when(F.lower(text).isin(NULLISH), "").otherwise(text)


def truncate_text(c: Column, limit: int, mark: str = "…") -> Column:
    """At most limit signs, the mark included."""
    text = clean_text(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - len(mark))), F.lit(mark)))


def truncate_words(c: Column, limit: int) -> Column:
    """The first limit words; a shortened text ends in ' ...' without signs that want to go on."""
    words = F.split(clean_text(c), " ")
    short = F.regexp_replace(F.array_join(F.slice(words, 1, limit), " "), r"[ ,;:]+$", "")
    return F.when(F.size(words) <= limit, clean_text(c)).otherwise(F.concat(short, F.lit(" ...")))


def word_count(c: Column) -> Column:
    text = clean_text(c)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def slugify(*parts: Column, fallback: str = "item") -> Column:
    """Lower case, other signs than a-z 0-9 to one underscore."""
    text = F.concat_ws("_", *parts)
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", "_"), r"_+", "_")
    slug = F.regexp_replace(slug, r"^_+|_+$", "")
    return F.when(slug == "", fallback).otherwise(slug)


def clean_label(c: Column) -> Column:
    """Without a leading number and underscore."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^-*[0-9]+_", "")


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-case runs of a-z of at least so many letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[a-z]{{{max(1, least)},}}"), F.lit(0))


def yes_or_no(c: Column) -> Column:
    """yes, no, or NULL where the answer has neither, in English or Portuguese."""
    word = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), YES_NO, 1)
    return F.when(word.isin("yes", "sim"), "yes").when(word != "", "no")


def review_decision(c: Column) -> Column:
    """delete, not related or ''."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(text.isin("delete", "not related"), text).otherwise("")


def decision_status(decision: Column) -> Column:
    return F.when(decision == "delete", EXCLUDED_STATUS).when(decision == "not related", UNPAIRED_STATUS).otherwise(ALIGNED_STATUS)


def keyword_class(c: Column, classes: list[tuple[str, list[str]]], synonyms: list[tuple[str, list[str]]] = ()) -> Column:
    """A class that the text names, or is a synonym of, else the first one of whose words it has, else the text with underscores.

    Words for nothing are judged as they are written: 'none' has 'no' in it.
    """
    label = F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), r"[-\s/]+", "_"), r"^_+|_+$", "")

    def judged(text: Column) -> Column:
        out = text
        for name, words in reversed(classes):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(text, F.lit(w))
            out = F.when(hit, name).otherwise(out)
        for name, words in reversed(synonyms):
            out = F.when(text.isin(words), name).otherwise(out)
        return F.when(text.isin([name for name, _ in classes]), text).otherwise(out)

    return bound(label, judged)


def keep_or_exclude(c: Column) -> Column:
    """exclude only where it is said."""
    return F.when(F.lower(clean_text(c)) == "exclude", "exclude").otherwise("keep")


def without_stop_words(words: Column, stop_words: list[str] | None = None) -> Column:
    """Without the given words, by default Spark's own list for English."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    return F.filter(words, lambda w: ~w.isin(stop_words))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("1", "true", "yes", "y")


def chunk_id(document: Column, number: Column) -> Column:
    return F.concat(document.cast("string"), F.lit("::chunk_"), F.lpad(number.cast("string"), 4, "0"))


def format_year(c: Column) -> Column:
    return F.coalesce(c.cast("int").cast("string"), F.lit("NA"))


def format_lag(c: Column) -> Column:
    """lag +1, lag -2, lag +0."""
    return F.concat(F.lit("lag "), F.when(c >= 0, "+").otherwise(""), c.cast("string"))


def profile_text(label: Column, terms: Column, chunks: Column) -> Column:
    """Label, terms and numbered representative texts, a line each."""
    numbered = F.transform(chunks, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t))
    return F.concat_ws("\n", F.concat(F.lit("Label: "), label), F.concat(F.lit("Terms: "), F.array_join(terms, ", ")), F.array_join(numbered, "\n"))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\x1B\[[0-9;?]*[ -/]*[@-~]", "")


# Beyond built-in expressions: entities, HTML and balanced braces, on the standard library in Arrow batches.
_ZERO_WIDTH = re.compile("[\u200b-\u200f\u2060\ufeff]")
_BLOCKS = {"p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
_CELLS = {"td", "th"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = {"div", "table", "ul", "ol", "section", "article", "nav"}
_SKIPPED = {"script", "style", "noscript"}
_PAGE_MARK = re.compile(r"-?\s*\d+\s*-?")


def normalized(text: str | None) -> str:
    """Entities resolved, odd spaces and zero-width signs gone, lines trimmed, at most one blank line in a row."""
    text = html.unescape(text or "").replace("\x00", " ").replace("\u00a0", " ")
    text = _ZERO_WIDTH.sub("", text).replace("\r\n", "\n").replace("\r", "\n")
    lines = [re.sub(r"[ \t\f\v]+", " ", line).strip(" ") for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


class _Element:
    def __init__(self, tag: str, order: int) -> None:
        self.tag, self.order = tag, order
        self.texts: list[str] = []
        self.inside: set[str] = set()

    def is_paragraph(self) -> bool:
        """A cell that holds paragraphs, blocks or items is none itself, nor is a row that has cells."""
        if self.tag in _CELLS:
            return not self.inside & {"p", "div", "li"}
        if self.tag == "tr":
            return not self.inside & _CELLS
        return self.tag in _BLOCKS


class _Paragraphs(HTMLParser):
    """Collects the texts of block elements with all that is in them; elements left open end where their kind does."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.found: list[_Element] = []
        self.everything: list[str] = []
        self.skip = 0
        self.order = 0

    def _close(self, down_to: int) -> None:
        while len(self.open) > down_to:
            self.found.append(self.open.pop())

    def _close_last(self, tags: set[str], within: set[str]) -> None:
        """Closes the innermost open element of the tags, unless one of `within` lies further inside."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                return self._close(i)
            if self.open[i].tag in within:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skip += 1
        if tag in _BLOCKS | _CONTAINERS and self.open and self.open[-1].tag in ({"p"} | (_HEADINGS if tag in _BLOCKS else set())):
            self._close(len(self.open) - 1)
        if tag == "li":
            self._close_last({"li"}, {"ul", "ol", "table"})
        elif tag in _CELLS:
            self._close_last(_CELLS, {"tr", "table"})
        elif tag == "tr":
            self._close_last({"tr"}, {"table"})
        for element in self.open:
            element.inside.add(tag)
        if tag in _BLOCKS | _CONTAINERS:
            self.open.append(_Element(tag, self.order))
            self.order += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED and self.skip:
            self.skip -= 1
        self._close_last({tag}, set())

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.everything.append(data)
            for element in self.open:
                element.texts.append(data.strip())


def paragraphs_of(raw: str | None) -> list[str]:
    """Paragraph texts in document order, without page marks and repeats of the one before; the whole text if there is none."""
    if not normalized(raw):
        return []
    parser = _Paragraphs()
    parser.feed(raw or "")
    parser.close()
    parser._close(0)
    out: list[str] = []
    for element in sorted(parser.found, key=lambda e: e.order):
        text = normalized(" ".join(element.texts)) if element.is_paragraph() else ""
        if text and not _PAGE_MARK.fullmatch(text) and (not out or text != out[-1]):
            out.append(text)
    if not out and (whole := normalized(" ".join(p.strip() for p in parser.everything))):
        out = [whole]
    return out


def normalize_text(c: Column | str) -> Column:
    return F.pandas_udf(_normalized_series, "string")(c)


def html_paragraphs(c: Column | str) -> Column:
    return F.pandas_udf(_paragraph_series, "array<string>")(c)


def _normalized_series(texts: pd.Series) -> pd.Series:
    return texts.map(normalized)


def _paragraph_series(raw: pd.Series) -> pd.Series:
    return raw.map(paragraphs_of)


def join_paragraphs(paragraphs: Column) -> Column:
    return F.array_join(F.filter(paragraphs, lambda p: F.trim(p) != ""), "\n\n")


def json_object_in(text: str | None) -> str | None:
    """The first balanced {...} of a text, braces in strings aside."""
    text = text or ""
    start, depth, quoted, escaped = -1, 0, False, False
    for i, sign in enumerate(text):
        if quoted:
            quoted, escaped = (quoted and (escaped or sign != '"')), (sign == "\\" and not escaped)
            continue
        if sign == '"' and start >= 0:
            quoted = True
        elif sign == "{":
            start = i if depth == 0 else start
            depth += 1
        elif sign == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def extract_json_object(c: Column | str) -> Column:
    return F.pandas_udf(_json_series, "string")(c)


def _json_series(texts: pd.Series) -> pd.Series:
    return texts.map(json_object_in)
