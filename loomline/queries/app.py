"""The tables of a reader's app, and the bundle that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import comparisons, series, serving
from ..operators.relational import top_by
from ..plans.corpus import chunks
from ..sources import bundle
from ..storage import shared_folder, stored
from .comparisons import _ANCHOR_VALUES, _YEARS_SQL, aligned_series, unpaired_series
from .narratives import _BRAND_SQL, told
from .registry import query
from .review import _REVIEW_SQL, reviewed
from .series import BRAND

WORDS, DOCS = 14, 3
_ID = "source || '::' || macro_topic || '::' || brand"
_TOPICS_SQL = f"""{_REVIEW_SQL}, {_BRAND_SQL}, app AS (
  SELECT n.*, {_ID} AS topic_id, CASE WHEN source = 'corporate' THEN 'corporate_anchor' ELSE coalesce(paper_status, 'reviewed_external') END AS paper_status FROM narr n LEFT JOIN rv USING (source, macro_topic, brand) WHERE coalesce(paper_status, '') <> 'excluded'
)"""


def _topic_id() -> Column:
    return F.concat_ws("::", "source", "macro_topic", "brand")


def topics(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Topics that review kept, with their status; corporate ones are anchors."""
    status = reviewed(spark, sf_dir, base).select(*BRAND, "paper_status")
    rows = told(spark, sf_dir, BRAND, base).join(status, BRAND, "left").where(F.coalesce("paper_status", F.lit("")) != "excluded")
    kind = F.when(F.col("source") == "corporate", "corporate_anchor").otherwise(F.coalesce("paper_status", F.lit("reviewed_external")))
    return rows.withColumns({"topic_id": _topic_id(), "paper_status": kind})


def _given(spark: SparkSession, sf_dir: str, base: DataFrame | None, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Chunks and topics, made here where several tables do not share them."""
    base = stored(chunks(spark, sf_dir)) if base is None else base
    return base, topics(spark, sf_dir, base) if known is None else known


@query(
    f"""WITH {_TOPICS_SQL}, act AS (SELECT source, macro_topic, brand, count(DISTINCT document_id) AS topic_size, count(DISTINCT year) AS active_year_count, min(year) AS active_year_min, max(year) AS active_year_max FROM base GROUP BY ALL)
SELECT topic_id, source, macro_topic, brand, label AS display_label, paper_status, overall_summary, evolution_pattern, evidence_note, topic_size, active_year_count, active_year_min, active_year_max FROM app JOIN act USING (source, macro_topic, brand)"""
)
def app_topics(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    base, known = _given(spark, sf_dir, base, known)
    sizes = base.groupBy(*BRAND).agg(F.count_distinct("document_id").alias("topic_size"))
    years = base.select(*BRAND, "year").distinct().groupBy(*BRAND).agg(F.count("year").alias("active_year_count"), F.min("year").alias("active_year_min"), F.max("year").alias("active_year_max"))
    active = sizes.join(years, BRAND)
    return known.join(active, BRAND).select("topic_id", *BRAND, F.col("label").alias("display_label"), "paper_status", "overall_summary", "evolution_pattern", "evidence_note", "topic_size", "active_year_count", "active_year_min", "active_year_max")


@query(
    f"""WITH {_TOPICS_SQL}, {_YEARS_SQL}, v AS (SELECT source, macro_topic, brand, year, count(*) AS f, count(DISTINCT document_id) AS n FROM base GROUP BY ALL), y AS (SELECT source, macro_topic, year, count(DISTINCT document_id) AS d FROM base GROUP BY ALL), o AS (SELECT source, macro_topic, count(DISTINCT document_id) AS denominator FROM base GROUP BY ALL)
SELECT topic_id, macro_topic, source, year, {_ANCHOR_VALUES} FROM app CROSS JOIN yrs LEFT JOIN v USING (source, macro_topic, brand, year) LEFT JOIN y USING (source, macro_topic, year) LEFT JOIN o USING (source, macro_topic)"""
)
def app_year_series(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, known: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Every topic on the whole grid of years, with counts, denominators and shares."""
    base, known = _given(spark, sf_dir, base, known)
    keys = stored(known.select(*BRAND))
    rows = comparisons.anchor_series(keys, base, BRAND, ["source", "macro_topic"], cells)
    return rows.withColumn("topic_id", _topic_id()).drop("brand")


@query(
    f"""WITH {_TOPICS_SQL}, c AS (SELECT source, macro_topic, brand, topic, count(*) AS component_count FROM base GROUP BY ALL)
SELECT topic_id, macro_topic, source, c.topic AS component_micro_topic_id, component_count, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY component_count DESC, c.topic) AS INTEGER) AS component_order FROM app JOIN c USING (source, macro_topic, brand)"""
)
def app_merge_components(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The topics that were merged into each, the largest first."""
    base, known = _given(spark, sf_dir, base, known)
    parts = base.groupBy(*BRAND, F.col("topic").alias("component_micro_topic_id")).agg(F.count(F.lit(1)).alias("component_count"))
    rows = known.select("topic_id", *BRAND).join(parts, BRAND)
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("component_count"), "component_micro_topic_id"))
    return rows.select("topic_id", "macro_topic", "source", "component_micro_topic_id", "component_count", place.alias("component_order"))


_ORDER = "ORDER BY score DESC, document_id, item, part_id"


@query(
    f"""WITH {_TOPICS_SQL}, r AS (SELECT source, macro_topic, brand, year, topic, document_id, CAST(document_id AS VARCHAR) || '::chunk_' || lpad(CAST(item AS VARCHAR), 4, '0') AS chunk_id, row_number() OVER (PARTITION BY source, macro_topic, brand, year {_ORDER}) AS k FROM base),
w AS (SELECT source, macro_topic, brand, year, lower(topic) AS w, min(k) AS k FROM r GROUP BY ALL), wk AS (SELECT *, row_number() OVER (PARTITION BY source, macro_topic, brand, year ORDER BY k) AS o FROM w)
SELECT topic_id, year, (SELECT to_json(list(first_topic ORDER BY o)) FROM (SELECT wk.o, r.topic AS first_topic FROM wk JOIN r ON r.source = wk.source AND r.macro_topic = wk.macro_topic AND r.brand = wk.brand AND r.year = wk.year AND r.k = wk.k WHERE wk.source = g.source AND wk.macro_topic = g.macro_topic AND wk.brand = g.brand AND wk.year = g.year AND wk.o <= {WORDS})) AS top_words_json, docs AS representative_docs_json
FROM (SELECT source, macro_topic, brand, year, to_json(list({{'chunk_id': chunk_id, 'document_id': document_id, 'display_policy': CASE source WHEN 'corporate' THEN 'full' WHEN 'media' THEN 'words' ELSE 'snippet' END}} ORDER BY k) FILTER (k <= {DOCS})) AS docs FROM r GROUP BY ALL) g JOIN app USING (source, macro_topic, brand)"""
)
def app_year_evidence(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Per topic and year the words of its best chunks, each once, and the best chunks with how they may be shown."""
    base, known = _given(spark, sf_dir, base, known)
    keys = [*BRAND, "year"]
    order = [F.desc("score"), F.col("document_id"), F.col("item"), F.col("part_id")]
    rows = base
    score = F.col("score")
    place = F.struct(score.isNull().alias("none"), (~F.isnan(score)).alias("number"), (-score).alias("score"), "document_id", "item", "part_id", "topic")
    firsts = rows.groupBy(*keys, F.lower("topic").alias("w")).agg(F.min(place).alias("f"))
    words = firsts.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list("f")), 1, WORDS), lambda x: x["topic"]).alias("words"))
    policy = F.when(F.col("source") == "corporate", "full").when(F.col("source") == "media", "words").otherwise("snippet")
    best = top_by(rows, keys, order, DOCS, "k").withColumn("doc", F.struct(text.chunk_id(F.col("document_id"), F.col("item")).alias("chunk_id"), "document_id", policy.alias("display_policy")))
    docs = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc"))), lambda x: x["doc"]).alias("docs"))
    out = known.select("topic_id", *BRAND).join(words, BRAND).join(docs, keys)
    return out.select("topic_id", "year", F.to_json("words").alias("top_words_json"), F.to_json("docs").alias("representative_docs_json"))


@query(f"WITH {_TOPICS_SQL} SELECT topic_id, source, macro_topic, paper_status, topic_id = 'media::T1::Brand#13' AS is_selected FROM app WHERE (source IN ('academic', 'corporate') AND macro_topic IN ('T1', 'T2') AND paper_status IN ('aligned', 'corporate_anchor')) OR topic_id = 'media::T1::Brand#13'")
def app_filtered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees with filters on sources, macro topics and status, and one topic chosen outside them."""
    filters = {"source": ["academic", "corporate"], "macro_topic": ["T1", "T2"], "paper_status": ["aligned", "corporate_anchor"]}
    return serving.shown_topics(topics(spark, sf_dir), filters, "media::T1::Brand#13").select("topic_id", "source", "macro_topic", "paper_status", "is_selected")


_RELATIONS_SQL = """x AS (SELECT topic_id, source, macro_topic, brand FROM app WHERE paper_status = 'aligned'), c AS (SELECT topic_id, macro_topic, brand FROM app WHERE source = 'corporate'), n AS (SELECT source, macro_topic, brand, count(DISTINCT document_id) AS k FROM base GROUP BY ALL)"""


@query(
    f"""WITH {_TOPICS_SQL}, {_RELATIONS_SQL} SELECT x.macro_topic, c.topic_id AS corporate_topic_id, cn.k AS corporate_unique_document_count, x.topic_id AS external_topic_id, x.source AS source_noncorporate, xn.k AS external_unique_document_count
FROM x JOIN c USING (macro_topic, brand) JOIN n xn ON xn.source = x.source AND xn.macro_topic = x.macro_topic AND xn.brand = x.brand JOIN n cn ON cn.source = 'corporate' AND cn.macro_topic = x.macro_topic AND cn.brand = x.brand"""
)
def app_relations(spark: SparkSession, sf_dir: str, base: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Aligned external topics with their anchor, both of which review kept."""
    base, known = _given(spark, sf_dir, base, known)
    counts = base.groupBy(*BRAND).agg(F.count_distinct("document_id").alias("n"))
    rows = stored(known.select("topic_id", *BRAND, "paper_status").join(counts, BRAND))
    own = rows.where("source = 'corporate'").select("macro_topic", "brand", F.col("topic_id").alias("corporate_topic_id"), F.col("n").alias("corporate_unique_document_count"))
    external = rows.where("paper_status = 'aligned'").select("macro_topic", "brand", F.col("topic_id").alias("external_topic_id"), F.col("source").alias("source_noncorporate"), F.col("n").alias("external_unique_document_count"))
    return external.join(own, ["macro_topic", "brand"]).drop("brand")


KEYS = {"topics": ["topic_id"], "year_series": ["topic_id", "year"], "topic_merge_components": ["topic_id", "component_order"], "year_evidence": ["topic_id", "year"], "relations": ["external_topic_id"], "panel_series": ["corporate_topic_id", "source", "year"], "unpaired_series": ["topic_id", "year"]}
REFERENCES = [*[bundle.Reference(t, c, "topics", "topic_id") for t, c in (("year_series", "topic_id"), ("topic_merge_components", "topic_id"), ("year_evidence", "topic_id"), ("relations", "corporate_topic_id"), ("relations", "external_topic_id"), ("panel_series", "corporate_topic_id"), ("unpaired_series", "topic_id"))]]


def app_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    anchor = F.concat_ws("::", F.lit("corporate"), "macro_topic", "brand")
    base = stored(chunks(spark, sf_dir))
    known = stored(topics(spark, sf_dir, base))
    cells = series.document_cells(base, BRAND, ["source", "macro_topic"])
    return {
        "topics": app_topics(spark, sf_dir, base, known),
        "year_series": app_year_series(spark, sf_dir, base, known, cells),
        "topic_merge_components": app_merge_components(spark, sf_dir, base, known),
        "year_evidence": app_year_evidence(spark, sf_dir, base, known),
        "relations": app_relations(spark, sf_dir, base, known),
        "panel_series": aligned_series(spark, sf_dir, base, cells).withColumn("corporate_topic_id", anchor),
        "unpaired_series": unpaired_series(spark, sf_dir, base, cells).withColumn("topic_id", _topic_id()),
    }


@query(
    f"""WITH {_TOPICS_SQL}, {_YEARS_SQL}, {_RELATIONS_SQL}, y AS (SELECT count(*) AS y FROM yrs) SELECT 'topics' AS table_name, count(*) AS row_count FROM app UNION ALL SELECT 'year_series', count(*) FROM app, yrs UNION ALL SELECT 'topic_merge_components', count(*) FROM (SELECT DISTINCT source, macro_topic, brand, topic FROM base) JOIN app USING (source, macro_topic, brand)
UNION ALL SELECT 'year_evidence', count(*) FROM (SELECT DISTINCT source, macro_topic, brand, year FROM base) JOIN app USING (source, macro_topic, brand) UNION ALL SELECT 'relations', count(*) FROM x JOIN c USING (macro_topic, brand) UNION ALL SELECT 'panel_series', 3 * count(*) * any_value(y) FROM c, y UNION ALL SELECT 'unpaired_series', count(*) * any_value(y) FROM rv, y WHERE paper_status = 'external_relevant_unpaired'"""
)
def app_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven tables written as one version, checked and read back: how many rows each has."""
    root = f"{shared_folder(spark)}/bundles"
    token = bundle.write_bundle(spark, root, app_tables(spark, sf_dir), KEYS, REFERENCES)
    tables, missing = bundle.load_bundle(spark, root, token, list(KEYS))
    if missing:
        raise ValueError(f"missing tables: {missing}")
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out
