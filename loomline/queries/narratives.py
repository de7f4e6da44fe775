"""Narratives of topics, written from their own years and counts, compared across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import narratives
from ..plans.corpus import BASE_SQL, chunks
from ..storage import stored
from .registry import query
from .series import _REL_SQL, BRAND, relation_summary

# Of each topic up to four phases of equal length, what happened in them, and whether its evidence is sparse. One in five
# has no summary, so it isn't ready; phases of news have no years after the first.


def _told(name: str, keys: str, label: str) -> str:
    return f"""{name}_y AS (SELECT {keys}, year, count(*) AS n, count(DISTINCT document_id) AS d FROM base GROUP BY ALL
), {name}_t AS (SELECT {keys}, min(year) AS first_year, max(year) AS last_year, arg_max(year, (n, -year)) AS peak_year, sum(n) AS n, sum(d) AS d, min(n) AS least, count(*) FILTER (n < 3) AS thin FROM {name}_y GROUP BY ALL
), {name}_p AS (SELECT {keys}, CAST(4 * (year - first_year) // (last_year - first_year + 1) AS INTEGER) + 1 AS phase, min(year) AS y0, max(year) AS y1, CAST(sum({name}_y.n) AS BIGINT) AS n, CAST(sum({name}_y.d) AS BIGINT) AS d, arg_max(year, ({name}_y.n, -year)) AS peak FROM {name}_y JOIN {name}_t USING ({keys}) GROUP BY ALL
), {name}_w AS (SELECT {keys}, phase, n, y0, y1, CASE WHEN source = 'media' AND phase > 1 THEN '' WHEN y0 = y1 THEN CAST(y0 AS VARCHAR) WHEN source = 'academic' THEN 'from ' || y0 || ' to ' || y1 ELSE y0 || '-' || y1 END AS years, n || ' chunks in ' || d || ' documents, most in ' || peak AS summary FROM {name}_p
), {name}_a AS (SELECT {keys}, string_agg(years || ' with ' || summary, '; ' ORDER BY phase) AS parts, arg_max(n, phase) - arg_min(n, phase) AS growth, string_agg('Phase ' || phase || ' (' || CASE WHEN years = '' THEN 'years not specified' ELSE years END || '): ' || summary, chr(10) ORDER BY phase) AS compact,
  count(*) FILTER (years <> '') > 0 AS dated, min(y0) FILTER (years <> '') AS s, max(y1) FILTER (years <> '') AS e FROM {name}_w GROUP BY ALL
), {name} AS (SELECT {keys}, first_year, peak_year, {label} AS label, CASE WHEN n % 5 = 0 THEN '' ELSE {label} || ' has ' || CAST(n AS BIGINT) || ' chunks in ' || CAST(d AS BIGINT) || ' documents from ' || first_year || ' to ' || last_year || ': ' || parts END AS overall_summary,
  CASE WHEN growth > 0 THEN 'growing' WHEN growth < 0 THEN 'declining' ELSE 'steady' END AS evolution_pattern, CASE WHEN least < 3 THEN 'Sparse evidence in ' || thin || ' years' ELSE 'Evidence in every year' END AS evidence_note, compact, dated AND n % 5 <> 0 AS ready, s, e FROM {name}_t JOIN {name}_a USING ({keys}))"""


_BRAND_SQL = _told("narr", "source, macro_topic, brand", "brand")
_TOPIC_SQL = _told("tops", "source, macro_topic, brand, topic", "topic")


def told(spark: SparkSession, sf_dir: str, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """keys, first_year, peak_year and the fields of a narrative."""
    base, label = chunks(spark, sf_dir) if base is None else base, F.col(keys[-1])
    # Stored: both the facts and the phases are made of these few rows.
    years = stored(base.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("d")))
    most = F.max(F.struct("n", (-F.col("year")).alias("y")))
    facts = years.groupBy(*keys).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), (-most["y"]).alias("peak_year"), F.sum("n").alias("total"), F.sum("d").alias("total_d"), F.min("n").alias("least"), F.count_if(F.col("n") < 3).alias("thin"))
    number = F.floor(4 * (F.col("year") - F.col("first_year")) / (F.col("last_year") - F.col("first_year") + 1)).cast("int") + 1
    phases = years.join(facts, keys).groupBy(*keys, number.alias("phase")).agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.sum("n").alias("n"), F.sum("d").alias("d"), (-most["y"]).alias("peak"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    y0, y1 = F.col("y0"), F.col("y1")
    written = F.when((F.col("source") == "media") & (F.col("phase") > 1), "").when(y0 == y1, y0.cast("string")).when(F.col("source") == "academic", text("from ", y0, " to ", y1)).otherwise(text(y0, "-", y1))
    phases = phases.select(*keys, "phase", "n", written.alias("years"), text(F.col("n"), " chunks in ", F.col("d"), " documents, most in ", F.col("peak")).alias("summary"))
    packed = phases.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("phase", "n", "years", "summary"))).alias("p")).join(facts, keys)
    parts = F.array_join(F.transform("p", lambda x: F.concat(x["years"], F.lit(" with "), x["summary"])), "; ")
    summary = F.when(F.col("total") % 5 == 0, "").otherwise(F.concat(text(label, " has ", F.col("total"), " chunks in ", F.col("total_d"), " documents from ", F.col("first_year"), " to ", F.col("last_year"), ": "), parts))
    last, first = F.element_at("p", -1)["n"], F.get("p", 0)["n"]
    pattern = F.when(last > first, "growing").when(last < first, "declining").otherwise("steady")
    note = F.when(F.col("least") < 3, text("Sparse evidence in ", F.col("thin"), " years")).otherwise("Evidence in every year")
    one = lambda i, c: F.coalesce(F.get(F.filter("p", lambda x: x["phase"] == i), 0)[c], F.lit("")).alias(f"phase_{i}_{c}")
    return packed.select(*keys, "first_year", "peak_year", label.alias("label"), summary.alias("overall_summary"), pattern.alias("evolution_pattern"), note.alias("evidence_note"), *[one(i, c) for i in range(1, 5) for c in ("years", "summary")])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External narratives (_a) with that of the corporate brand (_b)."""
    rows = told(spark, sf_dir, BRAND)
    external = rows.where("source <> 'corporate'").select(F.col("source").alias("external_source"), "macro_topic", "brand", F.lit("corporate").alias("_own"), "first_year", "peak_year")
    own = rows.select(F.col("source").alias("_own"), "macro_topic", "brand", F.col("first_year").alias("_first"), F.col("peak_year").alias("_peak"))
    pairs = external.join(own, ["_own", "macro_topic", "brand"]).withColumns({"first_active_year_gap": F.col("_first") - F.col("first_year"), "peak_year_gap": F.col("_peak") - F.col("peak_year")})
    known = rows.drop("first_year", "peak_year")
    return narratives.attach_narratives(pairs, known, {"_a": ["external_source", "macro_topic", "brand"], "_b": ["_own", "macro_topic", "brand"]}).drop("_own", "_first", "_peak", "first_year", "peak_year")


@query(
    f"""WITH {BASE_SQL}, {_BRAND_SQL} SELECT a.source AS external_source, macro_topic, brand, a.ready AND c.ready AS both_have_narratives, a.evolution_pattern = c.evolution_pattern AS same_evolution_pattern,
  CASE WHEN NOT (a.ready AND c.ready) THEN 'missing narrative on at least one side' WHEN a.evolution_pattern = c.evolution_pattern THEN 'both sides share the same labeled evolution pattern' WHEN contains(lower(a.evidence_note || c.evidence_note), 'sparse') THEN 'at least one side reports sparse evidence' ELSE 'patterns differ across the two discourse narratives' END AS narrative_alignment_note,
  CAST(a.s AS INTEGER) AS source_a_first_phase_start, CAST(a.e AS INTEGER) AS source_a_last_phase_end, CAST(c.s AS INTEGER) AS source_b_first_phase_start, CAST(c.e AS INTEGER) AS source_b_last_phase_end, CAST(greatest(0, least(a.e, c.e) - greatest(a.s, c.s) + 1) AS INTEGER) AS narrative_time_span_overlap
FROM narr a JOIN narr c USING (macro_topic, brand) WHERE a.source <> 'corporate' AND c.source = 'corporate'"""
)
def narrative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External and corporate narratives: whether both are there, the years that both cover, and how they align."""
    spans = [f"source_{s}_{c}" for s in ("a", "b") for c in ("first_phase_start", "last_phase_end")]
    return narratives.enriched_pairs(_pairs(spark, sf_dir), only_ready=False).select("external_source", "macro_topic", "brand", "both_have_narratives", "same_evolution_pattern", "narrative_alignment_note", *spans, "narrative_time_span_overlap")


@query(
    f"""WITH {BASE_SQL}, {_BRAND_SQL}, w AS (SELECT * FROM narr_w WHERE years <> '') SELECT a.source AS external_source, macro_topic, brand, a.phase AS phase_a, b.phase AS phase_b, CAST(least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1 AS INTEGER) AS shared_years,
  round((least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) / (least(a.y1 - a.y0, b.y1 - b.y0) + 1), 6) AS share_of_shorter, CASE WHEN a.y0 = b.y0 AND a.y1 = b.y1 THEN 'same_years' WHEN a.y0 >= b.y0 AND a.y1 <= b.y1 THEN 'a_within_b' WHEN b.y0 >= a.y0 AND b.y1 <= a.y1 THEN 'b_within_a' WHEN a.y0 < b.y0 THEN 'a_begins_first' ELSE 'b_begins_first' END AS phase_alignment
FROM w a JOIN w b USING (macro_topic, brand) WHERE a.source <> 'corporate' AND b.source = 'corporate' AND a.y0 <= b.y1 AND b.y0 <= a.y1"""
)
def phase_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of external narratives with those of the corporate one that share a year with them."""
    phases = narratives.phase_rows(told(spark, sf_dir, BRAND), BRAND)
    external = phases.where("source <> 'corporate'").withColumnRenamed("source", "external_source")
    met = narratives.overlap_join(external, phases.where("source = 'corporate'").drop("source"), ["macro_topic", "brand"])
    return narratives.phase_alignment(met).select(F.col("external_source_a").alias("external_source"), "macro_topic", "brand", "phase_a", "phase_b", "shared_years", "share_of_shorter", "phase_alignment")


_SIG = """CASE WHEN q = 0 THEN '0' WHEN q < 0.0001 THEN regexp_replace(regexp_replace(printf('%.2e', q), '0+e', 'e'), '\\.e', 'e') ELSE regexp_replace(regexp_replace(printf(CASE WHEN q < 0.001 THEN '%.6f' WHEN q < 0.01 THEN '%.5f' WHEN q < 0.1 THEN '%.4f' WHEN q < 1 THEN '%.3f' ELSE '%.2f' END, q), '0+$', ''), '\\.$', '') END"""


def _short(c: str, most: int) -> str:
    clean = rf"trim(regexp_replace({c}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
    return f"CASE WHEN length({clean}) <= {most} THEN {clean} ELSE trim(regexp_replace(substr({clean}, 1, {most}), ' [^ ]*$', '')) || '...' END"


def _paragraph(label: str, summary: str, phases: str) -> str:
    said = lambda c, none: f"coalesce(nullif({_short(c, 360)}, ''), '{none}')"
    return f"""'The corporate topic "' || c.label || '" and the ' || r.source_a || ' counterpart "' || {label} || '" show ' || CASE temporal_relation_label WHEN 'external_leads' THEN 'an apparent external lead' WHEN 'corporate_leads' THEN 'an apparent corporate lead' ELSE 'a synchronous or ambiguous relation' END || ', with a ' || CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END || ' association at the selected lag; the strongest Spearman association is at lag ' || best_lag
|| ' (' || CASE WHEN best_lag > 0 THEN 'external discourse leading corporate disclosure by ' || best_lag || ' year(s)' WHEN best_lag < 0 THEN 'corporate disclosure leading external discourse by ' || abs(best_lag) || ' year(s)' ELSE 'same-year coevolution' END || '), with r=' || printf('%.3f', r + 0.0) || ' and table-level q=' || coalesce({_SIG}, 'not available')
|| '. The corporate narrative is summarized as: ' || {said("c.overall_summary", "no corporate narrative summary available")} || '. Its period narrative highlights ' || {said("c.compact", "no corporate phase description available")} || '. The ' || r.source_a || ' narrative is summarized as: ' || {said(summary, "no external narrative summary available")} || '. Its period narrative highlights ' || {said(phases, "no external phase description available")}
|| '. The first-active-year gap is ' || (c.first_year - a.first_year) || ' year(s) and the peak-year gap is ' || (c.peak_year - a.peak_year) || ' year(s), so the relation is best read as an exploratory temporal alignment rather than causal evidence.'"""


_RELATED_SQL = f"""{_REL_SQL}, {_BRAND_SQL}, related AS (
  SELECT macro_topic, brand, source_a, lag AS best_lag, spearman_r AS r, round(q_table, 6) AS q, CASE WHEN abs(spearman_r) < 0.30 OR lag = 0 THEN 'synchronous_or_unclear' WHEN lag > 0 THEN 'external_leads' ELSE 'corporate_leads' END AS temporal_relation_label FROM rel
)"""
_SIDES_SQL = "FROM related r JOIN narr c ON c.source = 'corporate' AND c.macro_topic = r.macro_topic AND c.brand = r.brand JOIN narr a ON a.source = r.source_a AND a.macro_topic = r.macro_topic AND a.brand = r.brand"


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = relation_summary(spark, sf_dir).select("macro_topic", "brand", F.col("source_a").alias("external_source"), "best_lag", "best_spearman_r", "best_spearman_q_table", "temporal_relation_label")
    return relations.join(_pairs(spark, sf_dir), ["external_source", "macro_topic", "brand"])


@query(f"WITH {_RELATED_SQL} SELECT r.source_a AS external_source, r.macro_topic, r.brand, best_lag, r AS best_spearman_r, a.compact AS external_phases_compact, c.compact AS corporate_phases_compact, {_paragraph('a.label', 'a.overall_summary', 'a.compact')} AS comparison_paragraph {_SIDES_SQL}")
def individual_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated pairs of topics with both narratives in a paragraph."""
    return narratives.individual_comparisons(_related(spark, sf_dir)).select("external_source", "macro_topic", "brand", "best_lag", "best_spearman_r", "external_phases_compact", "corporate_phases_compact", "comparison_paragraph")


_PART_SUMMARY = _short("overall_summary", 260)


@query(
    f"""WITH {_RELATED_SQL}, {_TOPIC_SQL}, cnt AS (SELECT source, macro_topic, brand, topic, count(DISTINCT document_id) AS k FROM base WHERE source <> 'corporate' GROUP BY ALL
), held AS (SELECT source, macro_topic, brand, string_agg(label, '; ' ORDER BY k DESC, topic) AS labels, coalesce(string_agg(label || ': ' || {_PART_SUMMARY}, chr(10) || chr(10) ORDER BY k DESC, topic) FILTER (overall_summary <> ''), '') AS summaries, string_agg(label || chr(10) || compact, chr(10) || chr(10) ORDER BY k DESC, topic) AS phases, CAST(count(*) AS INTEGER) AS parts FROM cnt JOIN tops USING (source, macro_topic, brand, topic) GROUP BY ALL)
SELECT r.source_a AS external_source, r.macro_topic, r.brand, best_lag, parts AS external_component_count, labels AS external_component_labels, md5(summaries) AS external_summary_md5, md5(phases) AS external_phases_md5, r.source_a || ' aggregate' AS external_topic_label, {_paragraph("r.source_a || ' aggregate'", 'summaries', 'phases')} AS comparison_paragraph {_SIDES_SQL} JOIN held h ON h.source = r.source_a AND h.macro_topic = r.macro_topic AND h.brand = r.brand"""
)
def aggregate_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated anchors with all topics of a source together, the largest first, in a paragraph."""
    keys = [*BRAND, "topic"]
    parts = chunks(spark, sf_dir).where("source <> 'corporate'").groupBy(*keys).agg(F.count_distinct("document_id").alias("external_unique_document_count"))
    known = told(spark, sf_dir, keys).drop("first_year", "peak_year")
    relations = _related(spark, sf_dir).withColumn("source", F.col("external_source"))
    out = narratives.aggregate_comparisons(relations, parts, known, BRAND, keys)
    return out.select("external_source", "macro_topic", "brand", "best_lag", "external_component_count", "external_component_labels", F.md5("external_overall_summary").alias("external_summary_md5"), F.md5("external_phases_compact").alias("external_phases_md5"), "external_topic_label", "comparison_paragraph")
