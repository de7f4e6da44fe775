"""Tables for readers: inclusion with evidence, overrides, representative rows, references, narratives put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank_to_null, clean_text, truncate_text, truncate_words
from ..functions.vectors import dot
from ..storage import stored
from .neighbours import similar_pairs
from .relational import top_by


def include_by_best(pairs: DataFrame, topics: DataFrame, key: str, least: float) -> DataFrame:
    """Topics with their best counterpart at or above `least`, how many there are, and why the others are left out.

    pairs: (key, counterpart, similarity).
    """
    best = top_by(pairs, [key], [F.desc("similarity"), F.col("counterpart")], 1)
    good = pairs.where(F.col("similarity") >= least).groupBy(key).agg(F.count(F.lit(1)).alias("qualifying_pairs"), F.array_join(F.transform(F.array_sort(F.collect_set("counterpart")), lambda c: c.cast("string")), ",").alias("counterparts"))
    out = topics.join(best.select(key, F.col("counterpart").alias("best_counterpart"), F.col("similarity").alias("best_similarity")), key, "left").join(good, key, "left").fillna(0, ["qualifying_pairs"]).fillna("", ["counterparts"])
    reason = F.when(F.col("qualifying_pairs") > 0, "direct_pair_above_threshold").when(F.col("best_similarity").isNull(), "no_pair").otherwise("below_threshold")
    return out.withColumn("inclusion_reason", reason).withColumn("is_included", F.col("qualifying_pairs") > 0)


def overridden(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of an override table, where it has something to say, in place of one's own."""
    renamed = overrides.select(key, *[blank_to_null(F.col(c)).alias(f"_{c}") for c in columns], F.lit(True).alias("_o"))
    out = rows.join(renamed, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.withColumn("is_overridden", F.coalesce("_o", F.lit(False))).drop("_o", *[f"_{c}" for c in columns])


def merged_records(records: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """Field by field the first filled value in the order, and how many fields are filled."""
    own = [F.first(blank_to_null(F.col(c)), ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(c) for c in fields]
    rows = records.select(key, *own).distinct()
    score = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    return rows.withColumn("record_score", score).withColumn("is_ready", F.col("record_score") == len(fields))


def shown_topics(topics: DataFrame, filters: dict[str, list[str]], selected: str | None = None, key: str = "topic_id") -> DataFrame:
    """Topics that a reader's filters leave (column -> allowed values; none: all), and the selected one whatever they say, with is_selected."""
    kept = F.lit(True)
    for column, values in filters.items():
        kept = kept & F.coalesce(F.col(column).isin(values), F.lit(False)) if values else kept
    chosen = F.coalesce(F.col(key) == selected, F.lit(False)) if selected is not None else F.lit(False)
    return topics.where(kept | chosen).withColumn("is_selected", chosen)


def nearest_year(rows: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The row of the year nearest to the wanted one, the earlier of two."""
    return top_by(rows.withColumn("distance", F.abs(F.col("year") - wanted)), keys, [F.col("distance"), F.col("year")], 1)


def previous_overlap(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """Jaccard similarity of a year's word set and the one before; NULL for the first year."""
    before = F.lag(words).over(Window.partitionBy(*keys).orderBy("year"))
    out = rows.withColumn("_b", before)
    return out.withColumn("overlap_with_previous", F.round(F.try_divide(F.size(F.array_intersect(words, "_b")).cast("double"), F.size(F.array_union(words, "_b"))), 9)).drop("_b")


def reference_link(source: Column, identifier: Column) -> Column:
    """Where a document of each kind of source can be read."""
    return F.when(source == "academic", F.concat(F.lit("https://doi.org/"), identifier)).when(source == "media", F.concat(F.lit("https://news.example/"), identifier)).otherwise(F.concat(F.lit("filing "), identifier))


def display_text(source: Column, text: Column, snippet: int = 120, words: int = 30) -> Column:
    """Filings in full, news up to a number of words, other texts as a snippet."""
    return F.when(source == "corporate", clean_text(text)).when(source == "media", truncate_words(text, words)).otherwise(truncate_text(text, snippet))


def filing_parts(c: Column) -> Column:
    """accession, item and date (yyyy-mm-dd) out of an identifier like 0001234567-20-000123_item7_20200131."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^(\d{10}-\d{2}-\d{6})_item([0-9A-Za-z]+)_(\d{8})$", k), F.lit(""))
    date = part(3)
    return F.struct(part(1).alias("accession"), part(2).alias("item"), F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2)).alias("date"))


def silhouette(vectors: DataFrame, key: str, group: str, vector: str, per_group: int) -> DataFrame:
    """Cosine silhouette of at most per_group vectors of each group (a sample by hash): own mean distance against the nearest other group's.

    The mean distance of a unit vector to a group comes from the group's sum of vectors, so a row meets each group once,
    never each other row. A group of one has no own distance and no silhouette.
    """
    from .sampling import reservoir

    rows = stored(reservoir(vectors, group, key, per_group, 42).select(F.lit(1).alias("_all"), F.col(key).cast("string").alias("k"), F.col(group).alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("v")))
    parts = rows.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(sums.join(sizes, "g").select(F.lit(1).alias("_all"), F.col("g").cast("string").alias("k"), "g", "n", "v"))
    products = similar_pairs(rows, groups, ["_all"], "k", "v", digits=12).select(F.col("a").alias("k"), F.col("b").alias("name"), "similarity")
    met = products.join(rows.select("k", "g", dot(F.col("v"), F.col("v")).alias("self")), "k").join(groups.select(F.col("k").alias("name"), F.col("g").alias("other"), "n"), "name")
    own = F.max(F.when((F.col("g") == F.col("other")) & (F.col("n") > 1), 1 - (F.col("similarity") - F.col("self")) / (F.col("n") - 1)))
    other = F.min(F.when(F.col("g") != F.col("other"), 1 - F.col("similarity") / F.col("n")))
    each = met.groupBy("k", "g").agg(own.alias("own"), other.alias("other"))
    value = (F.col("other") - F.col("own")) / F.greatest("own", "other")
    return each.groupBy(F.col("g").alias(group)).agg(F.count(F.lit(1)).alias("sampled"), F.round(F.avg(value), 6).alias("silhouette"))
