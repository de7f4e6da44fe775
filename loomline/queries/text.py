"""Texts: cleaning, labels, chunks, terms, HTML and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists, numbers, text
from ..operators.chunking import page_chunks, page_paragraphs, token_chunks as chunk_windows
from ..operators.relational import top_by
from ..plans.corpus import table
from ..storage import stored
from .registry import query

_SPACE = r"[ \t\n\x0B\f\r]+"
_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))"


@query(f"SELECT doc_id, CAST(length({_CLEAN}) AS INTEGER) AS clean_length, md5({_CLEAN}) AS clean_md5, CASE WHEN length({_CLEAN}) <= 80 THEN {_CLEAN} ELSE rtrim(substr({_CLEAN}, 1, 79)) || '…' END AS snippet FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("clean_length"), F.md5(c).alias("clean_md5"), text.truncate_text(F.col("text"), 80).alias("snippet"))


@query(
    f"""WITH w AS (SELECT doc_id, {_CLEAN} AS c, string_split({_CLEAN}, ' ') AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) <= 20 THEN c ELSE regexp_replace(array_to_string(ws[1:20], ' '), '[ ,;:]+$', '') || ' ...' END AS display_text, CAST(CASE WHEN c = '' THEN 0 ELSE len(ws) END AS INTEGER) AS word_count, len(ws) > 20 AS is_truncated FROM w"""
)
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_words(c, 20).alias("display_text"), text.word_count(c).alias("word_count"), (text.word_count(c) > 20).alias("is_truncated"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace('12_' || p_name, '^-*[0-9]+_', '') AS label FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name"), F.col("p_brand")).alias("slug"), text.clean_label(F.concat(F.lit("12_"), "p_name")).alias("label"))


@query(
    """WITH d AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' Delete ' WHEN 1 THEN 'NOT RELATED' WHEN 2 THEN 'keep' WHEN 3 THEN '' END AS raw FROM part),
n AS (SELECT *, CASE WHEN lower(trim(coalesce(raw, ''))) IN ('delete', 'not related') THEN lower(trim(raw)) ELSE '' END AS decision FROM d)
SELECT p_partkey, decision, CASE decision WHEN 'delete' THEN 'excluded' WHEN 'not related' THEN 'external_relevant_unpaired' ELSE 'aligned' END AS paper_status FROM n"""
)
def decision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 5 == 0, " Delete ").when(F.col("p_size") % 5 == 1, "NOT RELATED").when(F.col("p_size") % 5 == 2, "keep").when(F.col("p_size") % 5 == 3, "")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.review_decision(raw).alias("decision"))
    return rows.withColumn("paper_status", text.decision_status(F.col("decision")))


_CHUNK_SQL = f"""w AS (SELECT doc_id, source, CASE WHEN {_CLEAN} = '' THEN [] ELSE string_split({_CLEAN}, ' ') END AS ws FROM documents), n AS (
  SELECT *, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 126 THEN 1 ELSE CAST(ceil((len(ws) - 126) / 110) AS BIGINT) + 1 END AS k FROM w
), c AS (
  SELECT doc_id, source, ws, unnest(range(0, k)) AS i FROM n
)"""


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " ")).alias("tokens"))
    return chunk_windows(docs, "doc_id", "tokens", 128, 16, 2)


@query(
    f"""WITH {_CHUNK_SQL} SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk_number, CAST(doc_id AS VARCHAR) || '::chunk_' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') AS chunk_id, md5(array_to_string(ws[i * 110 + 1 : i * 110 + 126], ' ')) AS chunk_md5,
CAST(len(ws[i * 110 + 1 : i * 110 + 126]) + 2 AS INTEGER) AS token_count, CAST(i * 110 AS INTEGER) AS chunk_start_token, CAST(i * 110 + len(ws[i * 110 + 1 : i * 110 + 126]) - 1 AS INTEGER) AS chunk_end_token FROM c"""
)
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunked(spark, sf_dir)
    return rows.select("doc_id", "chunk_number", text.chunk_id(F.col("doc_id"), F.col("chunk_number")).alias("chunk_id"), F.md5("chunk_text").alias("chunk_md5"), "token_count", "chunk_start_token", "chunk_end_token")


@query(f"WITH {_CHUNK_SQL} SELECT source, count(*) AS documents, CAST(sum(k) AS BIGINT) AS chunks, round(avg(k), 6) AS mean_chunks, round(median(k), 6) AS median_chunks, max(k) AS max_chunks FROM (SELECT source, doc_id, count(*) AS k FROM c GROUP BY ALL) GROUP BY source")
def chunks_per_doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = chunked(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("k").alias("chunks"), F.round(F.avg("k"), 6).alias("mean_chunks"), F.round(F.median("k"), 6).alias("median_chunks"), F.max("k").alias("max_chunks"))


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda t: length(t) >= 3))"


@query(
    f"""WITH t AS (SELECT item_id, unnest({_TERMS}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM t GROUP BY ALL)
SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS shared_terms, round(count(*) / (max(na.n) + max(nb.n) - count(*)), 6) AS term_jaccard
FROM t a JOIN t b ON a.w = b.w AND a.item_id < b.item_id JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id GROUP BY a.item_id, b.item_id"""
)
def term_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share a term, with the Jaccard similarity of their term sets."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    each = terms.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    a, b = (each.select(F.col("item_id").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"), "w") for s in ("a", "b"))
    pairs = a.join(b, "w").where(F.col("item_a") < F.col("item_b")).groupBy("item_a", "item_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared_terms"))
    return pairs.select("item_a", "item_b", "shared_terms", F.round(F.col("shared_terms") / (F.col("n_a") + F.col("n_b") - F.col("shared_terms")), 6).alias("term_jaccard"))


@query(
    f"""WITH d AS (SELECT {_TERMS} AS ws FROM documents), top AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w ORDER BY n DESC, w LIMIT 12), k AS (SELECT list_sort(list_filter(tops, lambda t: list_contains(ws, t))) AS k FROM d, (SELECT list(w) AS tops FROM top)),
p AS (SELECT term_a, term_b, count(*) AS n FROM (SELECT term_a, unnest(list_filter(k, lambda t: t > term_a)) AS term_b FROM (SELECT k, unnest(k) AS term_a FROM k)) GROUP BY ALL)
SELECT term_a, term_b, p.n AS pair_documents, round(ln(p.n * m / (da.n * db.n)) / nullif(-ln(p.n / m), 0), 6) AS npmi FROM p, (SELECT count(*) AS m FROM documents), top da, top db WHERE da.w = term_a AND db.w = term_b"""
)
def npmi_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised pointwise mutual information of the pairs of the twelve most frequent terms of all, over documents.

    The texts are tokenised once, into stored word lists. Of topics, each with its own terms, see quality.topic_pair_npmi.
    """
    lists = stored(table(spark, sf_dir, "documents").select(F.array_distinct(text.tokens(F.col("text"))).alias("t")))
    top = stored(lists.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(12))
    # The few terms of a document as one list, so that pairs come from within it.
    mine = lists.crossJoin(F.broadcast(top.agg(F.array_sort(F.collect_list("w")).alias("tops")))).select(F.array_intersect("tops", "t").alias("ws"))
    pairs = F.flatten(F.transform("ws", lambda a: F.transform(F.filter("ws", lambda b: b > a), lambda b: F.struct(a.alias("term_a"), b.alias("term_b")))))
    counts = mine.select(F.explode(pairs).alias("p")).groupBy("p.term_a", "p.term_b").agg(F.count(F.lit(1)).alias("pair_documents"))
    a, b = (top.select(F.col("w").alias(f"term_{s}"), F.col("n").alias(f"n_{s}")) for s in ("a", "b"))
    out = counts.join(F.broadcast(a), "term_a").join(F.broadcast(b), "term_b").crossJoin(F.broadcast(lists.agg(F.count(F.lit(1)).alias("m"))))
    npmi = F.try_divide(F.log(F.col("pair_documents") * F.col("m") / (F.col("n_a") * F.col("n_b"))), -F.log(F.col("pair_documents") / F.col("m")))
    return out.select("term_a", "term_b", "pair_documents", F.round(npmi, 6).alias("npmi"))


@query()
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each page in order; beyond SQL, tested on fixtures."""
    return page_paragraphs(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.posexplode("paragraphs").alias("paragraph_number", "paragraph"))


@query()
def html_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each page packed into chunks of at most 64 tokens."""
    return page_chunks(table(spark, sf_dir, "pages"), "page_id", "html", 64, 8, 2)


@query("SELECT event_type, count(*) AS events, CAST(count(k) AS BIGINT) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k, CAST(count(DISTINCT k) AS BIGINT) AS distinct_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def events_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_element_at(lists.count_map(F.col("props")), F.lit("k"))
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"), F.count_distinct("k").alias("distinct_k"))


@query("SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ' > ' ORDER BY turn, role, text) AS outline, arg_min(role, (turn, role, text)) AS first_role, arg_max(role, (turn, role, text)) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation in order, joined; first and last role."""
    order = F.struct("turn", "role", "text")
    line = F.concat_ws(":", "role", F.length("text").cast("string"))
    rows = table(spark, sf_dir, "conversations")
    outline = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), " > ")
    return rows.groupBy("conv_id").agg(outline.alias("outline"), F.min_by("role", order).alias("first_role"), F.max_by("role", order).alias("last_role"), F.count(F.lit(1)).alias("turns"))


@query(
    """WITH p AS (SELECT *, CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS VARCHAR) AS digits FROM part), s AS (SELECT *, CASE WHEN length(digits) < 2 THEN '0' || digits ELSE digits END AS sic2 FROM p)
SELECT p_partkey, sic2, CASE sic2 WHEN '01' THEN 'agriculture_crops' WHEN '02' THEN 'agriculture_livestock' WHEN '10' THEN 'metal_mining' WHEN '13' THEN 'oil_gas' WHEN '20' THEN 'food_manufacturing' END AS industry,
CAST(greatest(5, least(50, round_even(p_partkey * 0.02, 0))) AS INTEGER) AS min_topic_size, CAST(greatest(0, least(2010, 1995 + p_size) - greatest(2000, 1990 + p_size) + 1) AS INTEGER) AS overlap_years, round(ceil(p_retailprice / 100000 / 0.05) * 0.05, 6) AS axis_top
FROM s"""
)
def sector_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    two, size = numbers.sector(F.col("p_partkey")), F.col("p_size")
    rows = table(spark, sf_dir, "part")
    years = numbers.overlap_years(F.lit(2000), F.lit(2010), 1990 + size, 1995 + size)
    return rows.select("p_partkey", two.alias("sic2"), numbers.industry(two).alias("industry"), numbers.least_topic_size(F.col("p_partkey")).alias("min_topic_size"), years.alias("overlap_years"), F.round(numbers.axis_top(F.col("p_retailprice") / 100000), 6).alias("axis_top"))


@query(
    f"""WITH t AS (SELECT lang, unnest({_TERMS}) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM c)
SELECT lang, string_agg(w, ', ' ORDER BY k) AS top_terms, 'Label: ' || lang || chr(10) || 'Terms: ' || string_agg(w, ', ' ORDER BY k) || chr(10) || '[1] ' || lang AS profile FROM k WHERE k <= 5 GROUP BY lang"""
)
def topic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent terms of each language as a profile text."""
    each = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("w"))
    top = top_by(each.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")), ["lang"], [F.desc("n"), F.col("w")], 5, "k")
    terms = F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"])
    rows = top.groupBy("lang").agg(terms.alias("t"))
    return rows.select("lang", F.array_join("t", ", ").alias("top_terms"), text.profile_text(F.col("lang"), F.col("t"), F.array("lang")).alias("profile"))


# The words of text.YES_NO; DuckDB's expressions have no look-around, so the signs around are matched.
_YES_NO_SQL = r"regexp_extract(lower(coalesce(text, '')), '(^|[^\p{L}\p{N}_])(yes|no|sim|nao|não)([^\p{L}\p{N}_]|$)', 2)"


@query(f"SELECT conv_id, turn, md5(text) AS answer_md5, CASE WHEN {_YES_NO_SQL} IN ('yes', 'sim') THEN 'yes' WHEN {_YES_NO_SQL} <> '' THEN 'no' END AS verdict FROM conversations")
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yes or no out of whole free answers."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("answer_md5"), text.yes_or_no(F.col("text")).alias("verdict"))


_RAW_LABEL = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_LABEL_SQL = f"regexp_replace(regexp_replace(lower({_RAW_LABEL}), '[-\\s/]+', '_', 'g'), '^_+|_+$', '', 'g')"


def class_sql(label: str, classes: list[tuple[str, list[str]]], otherwise: str, synonyms: list[tuple[str, list[str]]] = ()) -> str:
    """The class that the label is or is a synonym of, else the first one of whose words it has."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    cases = f"WHEN {label} IN ({quoted(name for name, _ in classes)}) THEN {label} "
    cases += "".join(f"WHEN {label} IN ({quoted(words)}) THEN '{name}' " for name, words in synonyms)
    cases += " ".join("WHEN " + " OR ".join(f"contains({label}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in classes)
    return f"CASE {cases} ELSE {otherwise} END"


@query(f"WITH l AS (SELECT doc_id, {_LABEL_SQL} AS label FROM documents) SELECT doc_id, {class_sql('label', text.FUNCTION_KEYWORDS, 'md5(label)')} AS function_label FROM l")
def function_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free texts to the first class that one of their words stands for, others as a digest of the label they would be."""
    label = text.keyword_class(F.col("text"), text.FUNCTION_KEYWORDS)
    names = [name for name, _ in text.FUNCTION_KEYWORDS]
    return table(spark, sf_dir, "documents").select("doc_id", F.when(label.isin(names), label).otherwise(F.md5(label)).alias("function_label"))


@query("SELECT doc_id, round(n / sum(n) OVER (PARTITION BY source), 6) AS share_of_source FROM (SELECT doc_id, source, length(text) AS n FROM documents)")
def document_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by source first, and a join of these: a window would keep a source's rows in one task."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    totals = rows.groupBy("source").agg(F.sum("n").alias("total"))
    return rows.join(totals, rows.source.eqNullSafe(totals.source), "left").select("doc_id", F.round(F.col("n") / F.col("total"), 6).alias("share_of_source"))
