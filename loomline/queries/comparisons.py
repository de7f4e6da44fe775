"""Comparisons of topics across sources, model answers, and the columns and orders that reports need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists, numbers, payloads, sentences, text
from ..operators import comparisons, relations, series
from ..operators.relational import first_by, top_by
from ..plans.corpus import BASE_SQL, chunks, table
from ..storage import stored
from .registry import query
from .review import _REVIEW_SQL, reviewed
from .series import _CLASS_SQL, _GAP_SQL, _PREV_SQL, _SPEAR_SQL, BRAND, brand_prevalence, gaps, pair_best, spearman, with_q
from .text import class_sql

_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_NULLISH = ", ".join(f"'{w}'" for w in text.NULLISH)
_ANSWER_YEARS = "2000-2009"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a model's answer, under one of three sets of keys."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    kind, t = F.col("conv_id") % 3, F.col("t")
    said, last = F.get(t, 0)["text"], F.element_at(t, -1)["text"]
    steps = F.transform(t, lambda x: F.struct((x["turn"] + 2000).alias("year"), x["role"].alias("name"), x["text"].alias("description")))
    shifts = F.transform(t, lambda x: F.struct((x["turn"] + 2000).cast("string").alias("years"), x["text"].alias("details")))
    answer = F.struct(
        F.when(kind == 0, said).alias("title"),
        F.when(kind == 0, last).alias("summary"),
        F.when(kind == 0, steps).alias("steps"),
        F.when(kind == 1, F.struct(shifts.alias("key_policy_shifts"))).alias("analysis"),
        F.when(kind == 1, last).alias("conclusion"),
        F.when(kind == 2, F.transform(t, lambda x: x["text"])).alias("focus_areas"),
    )
    return turns.select("conv_id", F.to_json(answer).alias("answer"))


@query(
    rf"""WITH c AS (SELECT conv_id, turn, role, conv_id % 3 AS kind, CASE WHEN lower({_CLEAN}) IN ({_NULLISH}) THEN '' ELSE {_CLEAN} END AS c FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN kind = 0 THEN concat_ws(': ', role, nullif(c, '')) ELSE c END AS s, CAST(turn + 2000 AS VARCHAR) AS y FROM c),
g AS (SELECT conv_id, kind, max(c) FILTER (k = 1) AS said, arg_max(c, turn) AS last, coalesce(string_agg(c, '; ' ORDER BY turn) FILTER (c <> ''), '') AS areas, list(y ORDER BY k) FILTER (k <= 4) AS ys, list(s ORDER BY k) FILTER (k <= 4) AS ss FROM p GROUP BY ALL),
f AS (SELECT conv_id, CASE WHEN kind = 0 AND said <> '' THEN said ELSE 'Talk ' || conv_id END AS label,
  CASE WHEN kind = 2 THEN CASE WHEN areas = '' THEN '' ELSE 'Temporal synthesis centers on: ' || areas || '.' END WHEN last <> '' THEN last WHEN len(list_filter(ss, lambda x: x <> '')) > 0 THEN 'Temporal synthesis based on available phase evidence: ' || array_to_string(list_filter(ss, lambda x: x <> '')[1:2], ' ') ELSE '' END AS summary,
  CASE WHEN kind = 2 THEN areas ELSE '' END AS evidence, CASE WHEN kind = 2 THEN CASE WHEN areas = '' THEN [] ELSE ['{_ANSWER_YEARS}'] END ELSE ys END AS ys, CASE WHEN kind = 2 THEN [] ELSE ss END AS ss FROM g),
h AS (SELECT *, CASE WHEN len(ss) = 0 AND summary <> '' THEN [summary] ELSE ss END AS tt FROM f),
w AS (SELECT *, list_transform(list_filter(tt, lambda x: x <> ''), lambda x: substr(string_split(x, ':')[1], 1, 80)) AS names FROM h)
SELECT conv_id, md5(label) AS label_md5, md5(summary) AS summary_md5, md5(evidence) AS evidence_md5, md5(trim(regexp_replace(CASE WHEN len(names) > 1 THEN array_to_string(names, ' -> ') WHEN len(names) = 1 THEN 'Single phase observation' ELSE '' END, ' +', ' ', 'g'))) AS pattern_md5,
  coalesce(ys[1], '') AS phase_1_years, coalesce(ys[2], '') AS phase_2_years, coalesce(ys[3], '') AS phase_3_years, coalesce(ys[4], '') AS phase_4_years,
  md5(coalesce(tt[1], '')) AS phase_1_md5, md5(coalesce(tt[2], '')) AS phase_2_md5, md5(coalesce(tt[3], '')) AS phase_3_md5, md5(coalesce(tt[4], '')) AS phase_4_md5 FROM w"""
)
def canonical_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of answers written under different keys, with phases in a list, in an object's list, or none."""
    name = F.concat(F.lit("07_talk_"), F.col("conv_id").cast("string"))
    rows = _answers(spark, sf_dir).select("conv_id", payloads.canonical(F.col("answer"), name, F.lit(_ANSWER_YEARS)).alias("a")).select("conv_id", "a.*")
    digest = lambda c, name: F.md5(c).alias(name)
    four = range(1, payloads.PHASES + 1)
    return rows.select("conv_id", digest("topic_label_refined", "label_md5"), digest("overall_summary", "summary_md5"), digest("evidence_note", "evidence_md5"), digest("evolution_pattern", "pattern_md5"), *[f"phase_{i}_years" for i in four], *[digest(f"phase_{i}_summary", f"phase_{i}_md5") for i in four])


_WORD_LABEL = r"regexp_replace(regexp_replace(lower(word), '[-\s/]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(string_split({_CLEAN}, ' ')) AS word FROM (SELECT text FROM documents UNION ALL SELECT p_name FROM part UNION ALL SELECT event_type FROM events)), l AS (SELECT word, {_WORD_LABEL} AS label FROM w)
SELECT word, {class_sql("label", text.SAME_ISSUE_KEYWORDS, "label", text.SAME_ISSUE_SYNONYMS)} AS same_issue_assessment, {class_sql("label", text.RELATION_KEYWORDS, "label")} AS discourse_function_relation, {class_sql("label", text.FUNCTION_KEYWORDS, "label")} AS function_label,
  lower(word) IN ('true', 'yes', '1', 'keep') AS keep_for_discourse_analysis, CASE WHEN lower(word) = 'exclude' THEN 'exclude' ELSE 'keep' END AS decision FROM l"""
)
def word_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the texts as a one-word answer to the questions of a pair comparison."""
    # Names and types repeat, so each is cut into words once.
    named = [table(spark, sf_dir, name).select(F.col(c).alias("text")).distinct() for name, c in (("part", "p_name"), ("events", "event_type"))]
    texts = table(spark, sf_dir, "documents").select("text").unionByName(named[0]).unionByName(named[1])
    word = F.col("word")
    rows = texts.select(F.explode(F.split(text.clean_text(F.col("text")), " ")).alias("word")).distinct()
    return rows.select(
        "word",
        text.keyword_class(word, text.SAME_ISSUE_KEYWORDS, text.SAME_ISSUE_SYNONYMS).alias("same_issue_assessment"),
        text.keyword_class(word, text.RELATION_KEYWORDS).alias("discourse_function_relation"),
        text.keyword_class(word, text.FUNCTION_KEYWORDS).alias("function_label"),
        F.lower(word).isin(text.KEEP_WORDS).alias("keep_for_discourse_analysis"),
        text.keep_or_exclude(word).alias("decision"),
    )


_FACTS_SQL = f"""{_PREV_SQL}, tn AS (SELECT source, macro_topic, brand, topic, year, count(DISTINCT document_id) AS n FROM base GROUP BY ALL
), tp AS (SELECT tn.*, round(n / d, 6) AS prevalence FROM tn JOIN den USING (source, macro_topic, year)
), ta AS (SELECT *, row_number() OVER (PARTITION BY source, macro_topic, topic ORDER BY prevalence DESC, n DESC, year) AS k FROM tp
), ba AS (SELECT *, row_number() OVER (PARTITION BY source, macro_topic, brand ORDER BY prevalence DESC, document_count DESC, year) AS k FROM prev WHERE document_count > 0
), topics AS (SELECT source, macro_topic, brand, count(DISTINCT topic) AS external_topic_count FROM base GROUP BY ALL
), facts AS (
  SELECT 'aggregate' AS relation_level, source, macro_topic, brand, source || ' aggregate' AS external_relation_label, min(year) AS first_active_year, max(year) FILTER (k = 1) AS peak_year, count(*) AS active_year_count, max(prevalence) FILTER (k = 1) AS peak_prevalence FROM ba GROUP BY ALL
  UNION ALL SELECT 'individual', source, macro_topic, brand, topic, min(year), max(year) FILTER (k = 1), count(*), max(prevalence) FILTER (k = 1) FROM ta GROUP BY ALL
)"""


@query(
    f"""WITH {_FACTS_SQL} SELECT e.relation_level || '::' || e.macro_topic || '::' || e.brand || '::' || CASE e.relation_level WHEN 'aggregate' THEN e.source ELSE e.external_relation_label END AS relation_id, e.relation_level, e.macro_topic, e.brand, e.source AS external_source, e.external_relation_label,
  CASE e.relation_level WHEN 'aggregate' THEN external_topic_count ELSE 1 END AS external_topic_count, c.first_active_year AS corporate_first_active_year, e.first_active_year AS external_first_active_year, c.first_active_year - e.first_active_year AS first_active_year_gap,
  c.peak_year AS corporate_peak_year, e.peak_year AS external_peak_year, c.peak_year - e.peak_year AS peak_year_gap, c.active_year_count AS corporate_active_year_count, e.active_year_count AS external_active_year_count, c.peak_prevalence AS corporate_peak_prevalence, e.peak_prevalence AS external_peak_prevalence
FROM facts e JOIN facts c ON c.relation_level = 'aggregate' AND c.source = 'corporate' AND c.macro_topic = e.macro_topic AND c.brand = e.brand JOIN topics t ON t.source = e.source AND t.macro_topic = e.macro_topic AND t.brand = e.brand WHERE e.source <> 'corporate'"""
)
def relation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate brands against all topics of a source together, and against each of them."""
    base, keys = chunks(spark, sf_dir), ["macro_topic", "brand"]
    brands = series.series_stats(brand_prevalence(spark, sf_dir), BRAND)
    topics = series.series_stats(series.prevalence(base, [*BRAND, "topic"], ["source", "macro_topic"]), [*BRAND, "topic"])
    external = F.col("source") != "corporate"
    counts = base.groupBy(*BRAND).agg(F.count_distinct("topic").alias("external_topic_count"))
    together = brands.where(external).join(counts, BRAND).withColumnRenamed("source", "external_source").withColumn("external_relation_label", F.concat("external_source", F.lit(" aggregate")))
    each = topics.where(external).withColumnRenamed("source", "external_source").withColumn("external_relation_label", F.col("topic")).withColumn("external_topic_count", F.lit(1).cast("long"))
    anchors = brands.where(~external)
    return comparisons.relation_rows(anchors, together, keys, "aggregate").unionByName(comparisons.relation_rows(anchors, each, keys, "individual"))


_YEARS_SQL = "yrs AS (SELECT unnest(range((SELECT min(year) FROM base), (SELECT max(year) FROM base) + 1)) AS year)"
_ANCHOR_VALUES = """coalesce(f, 0) AS year_frequency, coalesce(n, 0) AS year_document_count, coalesce(denominator, 0) AS denominator, coalesce(d, 0) AS annual_source_macro_document_count,
  round(CASE WHEN coalesce(denominator, 0) = 0 THEN 0.0 ELSE coalesce(f, 0) / denominator END, 9) AS relative_share, round(CASE WHEN coalesce(d, 0) = 0 THEN 0.0 ELSE coalesce(n, 0) / d END, 9) AS annual_document_prevalence"""


@query(
    f"""WITH {BASE_SQL}, {_YEARS_SQL}, a AS (SELECT DISTINCT macro_topic, brand FROM base WHERE source = 'corporate'), r(source) AS (VALUES ('corporate'), ('academic'), ('media')),
v AS (SELECT source, macro_topic, brand, year, count(*) AS f, count(DISTINCT document_id) AS n FROM base GROUP BY ALL), y AS (SELECT source, macro_topic, year, count(DISTINCT document_id) AS d FROM base GROUP BY ALL), o AS (SELECT source, macro_topic, count(DISTINCT document_id) AS denominator FROM base GROUP BY ALL),
t AS (SELECT source, macro_topic, brand, count(DISTINCT topic) AS k, to_json(list(DISTINCT topic ORDER BY topic)) AS j FROM base WHERE source <> 'corporate' GROUP BY ALL)
SELECT macro_topic, brand, source, year, {_ANCHOR_VALUES}, coalesce(k, 0) AS contributing_external_group_count, coalesce(CAST(j AS VARCHAR), '[]') AS contributing_external_groups_json
FROM a CROSS JOIN r CROSS JOIN yrs LEFT JOIN v USING (source, macro_topic, brand, year) LEFT JOIN y USING (source, macro_topic, year) LEFT JOIN o USING (source, macro_topic) LEFT JOIN t USING (source, macro_topic, brand)"""
)
def aligned_series(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """For every corporate anchor three series, its own and those of the topics of either source that are aligned with it."""
    base = stored(chunks(spark, sf_dir).select(*BRAND, "topic", "year", "document_id")) if base is None else base
    roles = F.explode(F.array(*map(F.lit, ["corporate", "academic", "media"]))).alias("source")
    keys = base.where("source = 'corporate'").select("macro_topic", "brand").distinct().select("macro_topic", "brand", roles)
    rows = comparisons.anchor_series(keys, base, BRAND, ["source", "macro_topic"], cells)
    topics = base.where("source <> 'corporate'").select(*BRAND, "topic").distinct()
    groups = topics.groupBy(*BRAND).agg(F.count("topic").alias("contributing_external_group_count"), lists.sorted_json(F.col("topic")).alias("contributing_external_groups_json"))
    return rows.join(groups, BRAND, "left").fillna(0, ["contributing_external_group_count"]).fillna("[]", ["contributing_external_groups_json"])


@query(
    f"""WITH {_REVIEW_SQL}, {_YEARS_SQL}, a AS (SELECT DISTINCT source, macro_topic, brand FROM rv WHERE paper_status = 'external_relevant_unpaired'),
v AS (SELECT source, macro_topic, brand, year, count(*) AS f, count(DISTINCT document_id) AS n FROM base GROUP BY ALL), y AS (SELECT source, macro_topic, year, count(DISTINCT document_id) AS d FROM base GROUP BY ALL), o AS (SELECT source, macro_topic, count(DISTINCT document_id) AS denominator FROM base GROUP BY ALL)
SELECT macro_topic, brand, source, year, {_ANCHOR_VALUES} FROM a CROSS JOIN yrs LEFT JOIN v USING (source, macro_topic, brand, year) LEFT JOIN y USING (source, macro_topic, year) LEFT JOIN o USING (source, macro_topic)"""
)
def unpaired_series(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Series of the external topics that are kept without an anchor."""
    base = stored(chunks(spark, sf_dir).select(*BRAND, "year", "document_id")) if base is None else base
    keys = reviewed(spark, sf_dir, base).where("paper_status = 'external_relevant_unpaired'").select(*BRAND).distinct()
    return comparisons.anchor_series(keys, base, BRAND, ["source", "macro_topic"], cells)


_TOGETHER_SQL = """CASE WHEN r IS NULL THEN 'The same-year Spearman association is not available.'
  WHEN r < 0 THEN 'The same-year Spearman association is negative (rho=' || printf('%.3f', r + 0.0) || ', q=' || qt || '), so the peak result should be read as a timing contrast rather than contemporaneous co-movement.'
  WHEN r > 0 THEN 'The same-year Spearman association is positive (rho=' || printf('%.3f', r + 0.0) || ', q=' || qt || '), so the peak result complements a pattern of contemporaneous co-movement.'
  ELSE 'The same-year Spearman association is zero (rho=' || printf('%.3f', r + 0.0) || ', q=' || qt || ').' END"""


@query(
    f"""WITH {_SPEAR_SQL}, active AS {_GAP_SQL.split("active AS", 1)[1]}, j AS (
  SELECT g.*, s.r, coalesce(printf('%.3g', s.q), 'not available') AS qt FROM gaps g LEFT JOIN (SELECT macro_topic, brand, source_a, spearman_r AS r, round(q_table, 6) AS q FROM adj WHERE lag = 0) s ON s.macro_topic = g.macro_topic AND s.brand = g.brand AND s.source_a = external_source)
SELECT macro_topic, brand, external_source, 'For "' || brand || '" and "' || external_source || ' ' || brand || '", ' || CASE
  WHEN peak_year_gap > 1 THEN 'the ' || external_source || ' counterpart peaks ' || peak_year_gap || ' years before the corporate anchor. This is consistent with an external issue becoming salient before later corporate disclosure attention'
  WHEN peak_year_gap = 1 THEN 'the ' || external_source || ' counterpart peaks one year before the corporate anchor. This indicates a near-synchronous pattern with slight external precedence'
  WHEN peak_year_gap = 0 THEN 'both series peak in the same year, indicating synchronous maximum salience'
  WHEN peak_year_gap = -1 THEN 'the corporate anchor peaks one year before the external counterpart. This indicates a near-synchronous pattern with slight corporate precedence'
  ELSE 'the corporate anchor peaks ' || abs(peak_year_gap) || ' years before the ' || external_source || ' counterpart. This is consistent with corporate salience preceding the external maximum' END || '. ' || {_TOGETHER_SQL} AS interpretation FROM j"""
)
def peak_interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on whose peak comes first and whether both move together."""
    same_year = with_q(spearman(spark, sf_dir)).where("lag = 0").select(F.col("source_a").alias("external_source"), "macro_topic", "brand", "spearman_r", F.round("q_table", 6).alias("q"))
    rows = gaps(spark, sf_dir).join(same_year, ["external_source", "macro_topic", "brand"], "left")
    sentence = sentences.peak_sentence(F.col("brand"), F.concat_ws(" ", "external_source", "brand"), F.col("external_source"), F.col("peak_year_gap"), F.col("spearman_r"), F.col("q"))
    return rows.select("macro_topic", "brand", "external_source", sentence.alias("interpretation"))


@query(
    f"""WITH {_CLASS_SQL}, l AS (SELECT macro_topic, CASE precedence_class WHEN 'source_a_leads' THEN source_a || '_leads_' || source_b WHEN 'source_b_leads' THEN source_b || '_leads_' || source_a ELSE precedence_class END AS label FROM classed),
n AS (SELECT macro_topic, label, count(*) AS n, CASE label WHEN 'academic_leads_corporate' THEN 1 WHEN 'media_leads_corporate' THEN 2 WHEN 'corporate_leads_academic' THEN 3 WHEN 'corporate_leads_media' THEN 4 ELSE 5 END AS o FROM l GROUP BY ALL),
g AS (SELECT macro_topic, arg_max(label, (n, -o)) AS ruling, coalesce(sum(n) FILTER (o < 5), 0) AS led, coalesce(sum(n) FILTER (o = 5), 0) AS unclear, min(o) FILTER (o < 5) AS first FROM n GROUP BY ALL)
SELECT macro_topic, CASE WHEN ruling = 'synchronous_or_unclear' AND led = 0 THEN 'Mostly synchronous or inconclusive temporal ordering.'
  WHEN ruling = 'synchronous_or_unclear' THEN 'Mostly synchronous/co-evolving, with isolated ' || ['academic-leading', 'media-leading', 'corporate-leading-academic', 'corporate-leading-media'][first] || ' episodes (' || CAST(led AS BIGINT) || ' stable leading case' || CASE WHEN led <> 1 THEN 's' ELSE '' END || ').'
  ELSE upper(ruling[1]) || regexp_replace(substr(ruling, 2), '_leads_(.*)', ' discourse appears to lead \\1 discourse') || CASE WHEN unclear > 0 THEN ', but with residual synchronous or unclear cases.' ELSE '.' END END AS temporal_pattern FROM g"""
)
def dominant_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What order in time rules a macro topic. Only stable relations have a leader here, so all leading cases are stable."""
    rows = relations.precedence(pair_best(spark, sf_dir))
    a, b = F.col("source_a"), F.col("source_b")
    leader = F.when(F.col("precedence_class") == "source_a_leads", F.concat_ws("_leads_", a, b)).when(F.col("precedence_class") == "source_b_leads", F.concat_ws("_leads_", b, a)).otherwise(F.col("precedence_class"))
    labels = [*sentences.LEADERS, sentences.UNCLEAR]
    counts = rows.groupBy("macro_topic").agg(*[F.count_if(leader == k).alias(k) for k in labels])
    stable = sum((F.col(k) for k in sentences.LEADERS), F.lit(0))
    return counts.select("macro_topic", sentences.dominant_pattern({k: F.col(k) for k in labels}, stable).alias("temporal_pattern"))


@query(
    """WITH b AS (SELECT DISTINCT lang, text FROM documents WHERE text IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, text) AS representative_rank FROM b QUALIFY representative_rank <= 5),
m AS (SELECT lang, text, min(doc_id) AS doc_id FROM documents WHERE source = 'web' GROUP BY ALL) SELECT lang, CAST(representative_rank AS INTEGER) AS representative_rank, md5(text) AS text_md5, CAST(doc_id AS VARCHAR) AS document_id FROM t LEFT JOIN m USING (lang, text)"""
)
def representative_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's longest texts, with the first document of one source that has that text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text", "source")
    texts = top_by(docs.select("lang", "text").distinct(), ["lang"], [F.desc(F.length("text")), F.col("text")], 5, "representative_rank")
    found = comparisons.match_texts(texts, docs.where("source = 'web'").select("doc_id", "lang", "text"), ["lang"], "text", [F.col("doc_id")])
    return found.select("lang", "representative_rank", F.md5("text").alias("text_md5"), F.col("doc_id").cast("string").alias("document_id"))


_PINNED = ["Brand#23", "Brand#11"]


@query(f"WITH {BASE_SQL}, t AS (SELECT source, macro_topic, brand, count(*) AS n FROM base GROUP BY ALL) SELECT source, macro_topic, brand, n, CAST(row_number() OVER (PARTITION BY source, macro_topic ORDER BY CASE brand WHEN 'Brand#23' THEN 1 WHEN 'Brand#11' THEN 2 ELSE 3 END, n DESC, brand) AS INTEGER) AS position, CASE source WHEN 'corporate' THEN 1 WHEN 'academic' THEN 2 ELSE 3 END AS source_place FROM t")
def panel_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned brands first, then the largest; sources in their own order."""
    rows = chunks(spark, sf_dir).groupBy(*BRAND).agg(F.count(F.lit(1)).alias("n"))
    placed = comparisons.panel_order(rows, ["source", "macro_topic"], "brand", _PINNED, [F.desc("n"), F.col("brand")])
    return placed.withColumn("source_place", comparisons.by_category("source", ["corporate", "academic", "media"]).cast("int"))


@query(
    f"""WITH {_GAP_SQL}, sp AS (SELECT source, macro_topic, brand, min(year) AS first_year, max(year) FILTER (k = 1) AS peak_year, max(year) AS last_year FROM active GROUP BY ALL),
p AS (SELECT a.macro_topic, a.brand, a.source, a.first_year AS s, CASE WHEN a.source = 'media' THEN a.peak_year ELSE a.last_year END AS e, c.first_year AS cs, c.last_year AS ce FROM sp a JOIN sp c ON c.source = 'corporate' AND c.macro_topic = a.macro_topic AND c.brand = a.brand WHERE a.source <> 'corporate')
SELECT macro_topic, brand, source, CAST(s AS INTEGER) AS start_a, CAST(e AS INTEGER) AS end_a, CAST(cs AS INTEGER) AS start_b, CAST(ce AS INTEGER) AS end_b, CAST(greatest(0, least(e, ce) - greatest(s, cs) + 1) AS INTEGER) AS narrative_overlap_years FROM p"""
)
def narrative_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over phases that are written as text, and their overlap in years; news have no phase after their peak."""
    rows = brand_prevalence(spark, sf_dir).where("document_count > 0")
    last = rows.groupBy(*BRAND).agg(F.max("year").alias("last_year"))
    facts = series.series_stats(rows, BRAND).join(last, BRAND)
    year = lambda c: F.col(c).cast("string")
    written = [F.concat(year("first_active_year"), F.lit("-"), year("peak_year")), year("peak_year"), F.when(F.col("source") != "media", F.concat(F.lit("from "), year("peak_year"), F.lit(" to "), year("last_year"))), F.lit("no years")]
    spans = facts.select(*BRAND, comparisons.span([numbers.phase_years(w) for w in written]).alias("s"))
    own = spans.where("source = 'corporate'").select("macro_topic", "brand", F.col("s.start").alias("start_b"), F.col("s.end").alias("end_b"))
    pairs = spans.where("source <> 'corporate'").select("macro_topic", "brand", "source", F.col("s.start").alias("start_a"), F.col("s.end").alias("end_a")).join(own, ["macro_topic", "brand"])
    return pairs.withColumn("narrative_overlap_years", numbers.overlap_years(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b")))


@query(
    f"""WITH {_REVIEW_SQL}, n AS (SELECT source, macro_topic, brand, count(DISTINCT document_id) AS documents FROM base GROUP BY ALL), k AS (SELECT * FROM rv WHERE paper_status = 'aligned'),
c AS (SELECT macro_topic, brand, count(*) FILTER (source = 'academic') AS academic_counterpart_count, count(*) FILTER (source = 'media') AS media_counterpart_count, string_agg(source || ': ' || brand, '; ' ORDER BY source) AS counterpart_labels FROM k GROUP BY ALL)
SELECT n.source || '::' || n.macro_topic || '::' || n.brand AS topic_id, n.source, n.macro_topic, n.brand, n.documents, CASE WHEN n.source = 'corporate' THEN coalesce(academic_counterpart_count, 0) ELSE 0 END AS academic_counterpart_count, CASE WHEN n.source = 'corporate' THEN coalesce(media_counterpart_count, 0) ELSE 0 END AS media_counterpart_count,
  CASE WHEN n.source = 'corporate' THEN coalesce(counterpart_labels, '') WHEN k.brand IS NOT NULL AND p.brand IS NOT NULL THEN 'corporate::' || n.macro_topic || '::' || n.brand ELSE '' END AS counterparts, '' AS review_decision, '' AS review_note
FROM n LEFT JOIN c ON c.macro_topic = n.macro_topic AND c.brand = n.brand LEFT JOIN k ON k.source = n.source AND k.macro_topic = n.macro_topic AND k.brand = n.brand LEFT JOIN n p ON p.source = 'corporate' AND p.macro_topic = n.macro_topic AND p.brand = n.brand"""
)
def exclusion_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review sheet: anchors with their counterparts, external topics with their anchor, decisions left blank."""
    topics = chunks(spark, sf_dir).groupBy(*BRAND).agg(F.count_distinct("document_id").alias("documents"))
    topic_id = F.concat_ws("::", "source", "macro_topic", "brand")
    aligned = reviewed(spark, sf_dir).where("paper_status = 'aligned'").select(*BRAND)
    counterparts = aligned.groupBy("macro_topic", "brand").agg(F.count_if(F.col("source") == "academic").alias("academic_counterpart_count"), F.count_if(F.col("source") == "media").alias("media_counterpart_count"), lists.ordered_join(F.col("source"), F.concat_ws(": ", "source", "brand"), "; ").alias("counterparts"))
    corporate = topics.where("source = 'corporate'")
    anchors = corporate.join(counterparts, ["macro_topic", "brand"], "left").fillna(0, ["academic_counterpart_count", "media_counterpart_count"]).fillna("", ["counterparts"])
    paired = aligned.join(corporate.select("macro_topic", "brand", topic_id.alias("counterparts")), ["macro_topic", "brand"])
    external = topics.where("source <> 'corporate'").join(paired, BRAND, "left").fillna("", ["counterparts"])
    external = external.withColumns({"academic_counterpart_count": F.lit(0).cast("long"), "media_counterpart_count": F.lit(0).cast("long")})
    blank = {"topic_id": topic_id, "review_decision": F.lit(""), "review_note": F.lit("")}
    return anchors.unionByName(external).withColumns(blank)


@query(
    f"""WITH {_REVIEW_SQL}, v AS (SELECT macro_topic, source, CASE decision WHEN '' THEN 'same_issue' WHEN 'not related' THEN 'weak_match' ELSE 'adjacent_issue' END AS verdict FROM rv)
SELECT CASE WHEN grouping(macro_topic) = 0 AND grouping(source) = 0 THEN 'macro_topic_source' WHEN grouping(macro_topic) = 0 THEN 'macro_topic' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS grouping_level, macro_topic, source, count(*) AS pair_count,
  count(*) FILTER (verdict = 'same_issue') AS same_issue_count, count(*) FILTER (verdict = 'adjacent_issue') AS adjacent_issue_count, count(*) FILTER (verdict = 'weak_match') AS weak_match_count, round(count(*) FILTER (verdict = 'same_issue') / count(*), 6) AS same_issue_share
FROM v GROUP BY GROUPING SETS ((macro_topic, source), (macro_topic), (source), ())"""
)
def same_issue_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on pairs, counted over macro topic and source together, over each and over all, in one pass."""
    verdict = F.when(F.col("decision") == "", "same_issue").when(F.col("decision") == "not related", "weak_match").otherwise("adjacent_issue")
    rows = reviewed(spark, sf_dir).select("macro_topic", "source", verdict.alias("verdict"))
    level = F.when((F.grouping("macro_topic") == 0) & (F.grouping("source") == 0), "macro_topic_source").when(F.grouping("macro_topic") == 0, "macro_topic").when(F.grouping("source") == 0, "source").otherwise("all")
    counts = [F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in ("same_issue", "adjacent_issue", "weak_match")]
    out = rows.cube("macro_topic", "source").agg(level.alias("grouping_level"), F.count(F.lit(1)).alias("pair_count"), *counts)
    return out.withColumn("same_issue_share", F.round(F.col("same_issue_count") / F.col("pair_count"), 6))


@query(
    f"""WITH {BASE_SQL}, m AS (SELECT *, 'MG' || lpad(CAST(CAST(replace(brand, 'Brand#', '') AS INTEGER) % 5 AS VARCHAR), 2, '0') AS group_id FROM base),
g AS (SELECT source, macro_topic, group_id, year, count(*) AS group_chunk_n, count(DISTINCT document_id) AS group_doc_n, count(DISTINCT brand) AS member_count, to_json(list(DISTINCT brand ORDER BY brand)) AS members_json FROM m GROUP BY ALL)
SELECT source, macro_topic, group_id, year, group_chunk_n, group_doc_n, member_count, CAST(members_json AS VARCHAR) AS members_json, round(sum(group_doc_n) OVER w / sum(group_doc_n) OVER (PARTITION BY source, macro_topic, group_id), 9) AS cumulative_share FROM g WINDOW w AS (PARTITION BY source, macro_topic, group_id ORDER BY year ROWS UNBOUNDED PRECEDING)"""
)
def merged_annual_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual counts of merged groups over distinct documents, their members, and how much of their documents came so far."""
    number = F.replace("brand", F.lit("Brand#"), F.lit("")).cast("int") % 5
    rows = chunks(spark, sf_dir).withColumn("group_id", F.concat(F.lit("MG"), F.lpad(number.cast("string"), 2, "0")))
    keys = ["source", "macro_topic", "group_id"]
    counts = rows.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("group_chunk_n"), F.count_distinct("document_id").alias("group_doc_n"), F.count_distinct("brand").alias("member_count"), lists.sorted_json(F.col("brand")).alias("members_json"))
    own = series.Window.partitionBy(*keys)
    so_far = F.sum("group_doc_n").over(own.orderBy("year").rowsBetween(series.Window.unboundedPreceding, 0))
    return counts.withColumn("cumulative_share", F.round(so_far / F.sum("group_doc_n").over(own), 9))


@query(
    f"""WITH {BASE_SQL}, k AS (SELECT macro_topic, brand, year, CAST(document_id AS VARCHAR) || '::chunk_' || lpad(CAST(item AS VARCHAR), 4, '0') AS chunk_id, row_number() OVER (PARTITION BY macro_topic, brand, year ORDER BY score DESC, document_id, item, part_id) AS k FROM base)
SELECT macro_topic, brand, year, CAST(k AS INTEGER) AS rank, chunk_id FROM k WHERE k <= 5"""
)
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered columns of a year's evidence back as rows."""
    from .topics import year_evidence_top5

    return comparisons.numbered_to_rows(year_evidence_top5(spark, sf_dir), ["macro_topic", "brand", "year"], "chunk_id", 5)


@query(
    f"""WITH {BASE_SQL}, t AS (SELECT source, macro_topic, topic, count(DISTINCT document_id) AS n, min(year) AS lo, max(year) AS hi FROM base GROUP BY ALL)
SELECT source || '_' || macro_topic AS subgroup, count(*) AS topic_count, count(*) FILTER (n >= 5) AS selected_topic_count, round(count(*) FILTER (n >= 5) / count(*), 6) AS coverage_share, CAST(coalesce(sum(n) FILTER (n >= 5), 0) AS BIGINT) AS selected_documents, min(lo) FILTER (n >= 5) AS first_year, max(hi) FILTER (n >= 5) AS last_year FROM t GROUP BY ALL"""
)
def evolution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with enough documents to tell how they evolved, per subgroup."""
    topics = chunks(spark, sf_dir).groupBy("source", "macro_topic", "topic").agg(F.count_distinct("document_id").alias("n"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    chosen = F.col("n") >= 5
    return topics.groupBy(F.concat_ws("_", "source", "macro_topic").alias("subgroup")).agg(
        F.count(F.lit(1)).alias("topic_count"),
        F.count_if(chosen).alias("selected_topic_count"),
        F.round(F.count_if(chosen) / F.count(F.lit(1)), 6).alias("coverage_share"),
        F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)).alias("selected_documents"),
        F.min(F.when(chosen, F.col("lo"))).alias("first_year"),
        F.max(F.when(chosen, F.col("hi"))).alias("last_year"),
    )


@query(
    """WITH s AS (SELECT p_partkey, nullif(p_name, 'cold widget') AS name_x, p_brand AS name_y, p_type FROM part), k AS (SELECT p_type, count(*) AS type_parts, max(p_size) AS largest FROM part WHERE p_type <> 'PROMO' GROUP BY ALL)
SELECT '' AS reviewer, p_partkey, p_partkey AS part_id, coalesce(name_x, name_y) AS name, s.p_type, CAST(type_parts AS VARCHAR) AS type_parts, CAST(largest AS VARCHAR) AS largest FROM s LEFT JOIN k USING (p_type)"""
)
def refreshed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftovers of a join to one column, attributes as the catalogue has them, an alias, and columns in a report's order."""
    parts = table(spark, sf_dir, "part")
    stale = parts.select("p_partkey", F.nullif(F.col("p_name"), F.lit("cold widget")).alias("name_x"), F.col("p_brand").alias("name_y"), "p_type", F.lit(-1).alias("largest"))
    catalogue = parts.where("p_type <> 'PROMO'").groupBy("p_type").agg(F.count(F.lit(1)).cast("string").alias("type_parts"), F.max("p_size").cast("string").alias("largest"))
    rows = comparisons.refreshed(comparisons.coalesce_suffixes(stale, "name"), catalogue, "p_type")
    return comparisons.preferred_columns(comparisons.with_alias(rows, "part_id", "p_partkey"), ["reviewer", "p_partkey", "part_id", "name"])


@query(
    f"""WITH {_REVIEW_SQL}, n AS (SELECT source, macro_topic, brand, count(DISTINCT document_id) AS documents FROM base GROUP BY ALL),
b AS (SELECT n.macro_topic, CASE WHEN n.source = 'corporate' THEN 'anchor' WHEN paper_status = 'aligned' THEN 'linked' WHEN paper_status = 'excluded' THEN 'excluded' WHEN documents >= 10 THEN 'unlinked' ELSE 'backlog' END AS bucket, documents FROM n LEFT JOIN rv USING (source, macro_topic, brand))
SELECT coalesce(macro_topic, 'all') AS macro_topic, bucket || '_topics' AS metric, count(*) AS value FROM b GROUP BY GROUPING SETS ((macro_topic, bucket), (bucket)) UNION ALL SELECT coalesce(macro_topic, 'all'), bucket || '_documents', CAST(sum(documents) AS BIGINT) FROM b GROUP BY GROUPING SETS ((macro_topic, bucket), (bucket))"""
)
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, unlinked and backlog topics as a long table of metrics, with totals."""
    topics = chunks(spark, sf_dir).groupBy(*BRAND).agg(F.count_distinct("document_id").alias("documents"))
    status = first_by(reviewed(spark, sf_dir), BRAND, ["paper_status"]).select(*BRAND, "paper_status")
    bucket = F.when(F.col("source") == "corporate", "anchor").when(F.col("paper_status") == "aligned", "linked").when(F.col("paper_status") == "excluded", "excluded").when(F.col("documents") >= 10, "unlinked").otherwise("backlog")
    rows = topics.join(status, BRAND, "left").select("macro_topic", bucket.alias("bucket"), "documents")
    places = rows.select(F.explode(F.array(F.col("macro_topic"), F.lit("all"))).alias("macro_topic"), "bucket", "documents")
    counts = places.groupBy("macro_topic", "bucket").agg(F.count(F.lit(1)).alias("topics"), F.sum("documents").alias("docs"))
    pairs = F.array(F.struct(F.concat("bucket", F.lit("_topics")).alias("metric"), F.col("topics").alias("value")), F.struct(F.concat("bucket", F.lit("_documents")).alias("metric"), F.col("docs").alias("value")))
    return counts.select("macro_topic", F.explode(pairs).alias("m")).select("macro_topic", "m.metric", "m.value")
