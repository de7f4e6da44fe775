"""How good topics are: coherence of their top terms, overlap and diversity of terms, sizes, flags for review.

Documents are tokenised once, into lists of the terms that some topic of their group has; from these come document
frequencies and counts of pairs, of pairs within a topic alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import join_bounded, stored

# From where on a topic is flagged, and the flags.
LOW_COHERENCE, LOW_MARGIN, HIGH_OVERLAP, FEW_YEARS, LOW_STABILITY, STABLE_YEARS = 0.35, 0.05, 0.50, 5, 0.10, 3


def term_lists(docs: DataFrame, group: list[str], key: str, terms: Column, topic_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (group, key, term) of the terms that some topic of the group has, and per group the documents with any token (m)."""
    rows = docs.select(*group, F.col(key).alias("doc"), F.array_distinct(terms).alias("_t")).where(F.size("_t") > 0)
    vocabulary = topic_terms.select(*group, "term").distinct().groupBy(*group).agg(F.collect_set("term").alias("_v"))  # bounded by topics times their terms
    held = join_bounded(rows, vocabulary, group, "left").select(*group, "doc", F.coalesce(F.array_intersect("_t", "_v"), F.array().cast("array<string>")).alias("_t"))
    held = stored(held)
    return held.select(*group, "doc", F.explode("_t").alias("term")), held.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))


def pair_npmi(lists: DataFrame, documents: DataFrame, group: list[str], topic_terms: DataFrame) -> DataFrame:
    """group, topic, term_a, term_b (a < b), pair_documents, npmi for the pairs of a topic's terms; -1 for terms that never meet.

    topic_terms: group, topic, term. A pair that stands in every document has no NPMI.
    """
    own = topic_terms.select(*group, "topic", "term").distinct()
    df = lists.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("n"))
    met = join_bounded(lists, own, [*group, "term"]).groupBy(*group, "topic", "doc").agg(F.array_sort(F.collect_list("term")).alias("ts"))
    pairs = lambda c: F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: b > a), lambda b: F.struct(a.alias("term_a"), b.alias("term_b")))))
    alike = met.groupBy(*group, "topic", "ts").agg(F.count(F.lit(1)).alias("_n"))  # documents with the same terms of a topic make their pairs once
    counts = alike.select(*group, "topic", "_n", F.explode(pairs("ts")).alias("p")).groupBy(*group, "topic", "p.term_a", "p.term_b").agg(F.sum("_n").alias("pair_documents"))
    every = own.groupBy(*group, "topic").agg(F.array_sort(F.collect_list("term")).alias("ts")).select(*group, "topic", F.explode(pairs("ts")).alias("p")).select(*group, "topic", "p.term_a", "p.term_b")
    sides = [df.select(*group, F.col("term").alias(f"term_{s}"), F.col("n").alias(f"n_{s}")) for s in ("a", "b")]
    rows = every.join(counts, [*group, "topic", "term_a", "term_b"], "left").join(sides[0], [*group, "term_a"], "left").join(sides[1], [*group, "term_b"], "left")
    rows = join_bounded(rows, documents, group)
    together = F.col("pair_documents")
    npmi = F.try_divide(F.log(together * F.col("m") / (F.col("n_a") * F.col("n_b"))), -F.log(together / F.col("m")))
    return rows.select(*group, "topic", "term_a", "term_b", F.coalesce(together, F.lit(0)).alias("pair_documents"), F.when(together.isNull(), -1.0).otherwise(F.round(npmi, 9)).alias("npmi"))


def coherence(pairs: DataFrame, group: list[str]) -> DataFrame:
    """group, topic, coherence_npmi (mean of its pairs) and coherence_cv.

    coherence_cv: each term's vector of positive NPMI with the topic's terms, 1 with itself; the mean cosine of the terms'
    vectors with their mean direction.
    """
    keys = [*group, "topic"]
    mean = pairs.groupBy(*keys).agg(F.round(F.avg("npmi"), 6).alias("coherence_npmi"))
    value = F.greatest(F.coalesce("npmi", F.lit(0.0)), F.lit(0.0))
    both = [pairs.select(*keys, F.col(x).alias("term"), F.col(y).alias("other"), value.alias("v")) for x, y in (("term_a", "term_b"), ("term_b", "term_a"))]
    cells = both[0].unionByName(both[1])
    cells = stored(cells.unionByName(cells.select(*keys, "term", F.col("term").alias("other"), F.lit(1.0).alias("v")).distinct()))
    norms = cells.groupBy(*keys, "term").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    rows = stored(cells.join(norms, [*keys, "term"]).select(*keys, "term", "other", (F.col("v") / F.col("norm")).alias("v")))
    middle = rows.groupBy(*keys, "other").agg(F.avg("v").alias("c"))
    length = middle.groupBy(*keys).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("length"))
    cosine = rows.join(middle, [*keys, "other"]).groupBy(*keys, "term").agg(F.sum(F.col("v") * F.col("c")).alias("d")).join(length, keys)
    cv = cosine.groupBy(*keys).agg(F.round(F.avg(F.col("d") / F.col("length")), 6).alias("coherence_cv"))
    return mean.join(cv, keys, "left")


def similar_sets(sets: DataFrame, group: list[str], key: str, terms: str, least: float) -> DataFrame:
    """group, a, b (a < b), shared, jaccard of the sets with at least that Jaccard similarity (above 0).

    Prefix filter: with the rarest terms first, two such sets share one of their first |s| - ceil(least |s|) + 1 terms, so
    only these meet; whole sets are compared once per pair. A term that many sets have stands last in them.
    """
    rows = sets.select(*group, F.col(key).alias("k"), F.array_distinct(terms).alias("s")).where(F.size("s") > 0)
    each = rows.select(*group, "k", F.explode("s").alias("term"))
    df = each.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(df, [*group, "term"]).groupBy(*group, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("s"))
    ranked = stored(ranked)
    # A hair below, so that rounding never shortens a prefix that is needed.
    length = (F.size("s") - F.ceil(F.size("s") * least - 1e-9) + 1).cast("int")
    prefix = lambda side: ranked.select(*group, F.col("k").alias(side), F.explode(F.slice("s", F.lit(1), length)).alias("term"))
    met = prefix("a").join(prefix("b"), [*group, "term"]).where(F.col("a") < F.col("b")).select(*group, "a", "b").distinct()
    for side in ("a", "b"):
        met = met.join(ranked.select(*group, F.col("k").alias(side), F.col("s").alias(f"s_{side}")), [*group, side])
    shared = F.size(F.array_intersect("s_a", "s_b"))
    jaccard = shared / (F.size("s_a") + F.size("s_b") - shared)
    return met.select(*group, "a", "b", shared.alias("shared"), jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


def topic_quality(sizes: DataFrame, scores: DataFrame, overlaps: DataFrame, group: list[str], margins: DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """A row per topic: size, share of its group, coherence, and validation_flags, sorted and joined by ';'.

    sizes: group, topic, topic_size. overlaps: similar_sets of top terms. margins: group, topic, nearest_centroid_margin,
    has_near_centroid. years: group, topic, active_year_count, mean_consecutive_year_jaccard. A figure that is missing
    flags nothing.
    """
    keys = [*group, "topic"]
    near = overlaps.select(*group, F.explode(F.array("a", "b")).alias("topic")).distinct().withColumn("_overlap", F.lit(True))
    whole = sizes.groupBy(*group).agg(F.sum("topic_size").alias("_all"))
    rows = join_bounded(sizes, whole, group).join(scores, keys, "left").join(near, keys, "left")
    rows = rows.join(margins, keys, "left") if margins is not None else rows.withColumns({"nearest_centroid_margin": F.lit(None).cast("double"), "has_near_centroid": F.lit(False)})
    rows = rows.join(years, keys, "left") if years is not None else rows.withColumns({"active_year_count": F.lit(None).cast("long"), "mean_consecutive_year_jaccard": F.lit(None).cast("double")})
    active = F.col("active_year_count")
    flags = {
        "high_centroid_similarity": F.col("has_near_centroid"),
        "high_top_word_overlap": F.col("_overlap"),
        "low_centroid_margin": F.col("nearest_centroid_margin") < LOW_MARGIN,
        "low_cv_coherence": F.col("coherence_cv") < LOW_COHERENCE,
        "low_temporal_word_stability": (F.col("mean_consecutive_year_jaccard") < LOW_STABILITY) & (active >= STABLE_YEARS),
        "short_temporal_coverage": active < FEW_YEARS,
    }
    listed = F.concat_ws(";", *[F.when(c, name) for name, c in sorted(flags.items())])
    rows = rows.withColumns({"topic_share_non_outlier": F.round(F.col("topic_size") / F.col("_all"), 6), "validation_flags": listed}).drop("_all", "_overlap")
    return rows.withColumn("is_flagged_for_review", F.col("validation_flags") != "")


def group_summary(topics: DataFrame, topic_terms: DataFrame, overlaps: DataFrame, group: list[str]) -> DataFrame:
    """A row per group over its topics: how many, their sizes and how even these are, diversity of top terms, mean coherence, similar pairs.

    topic_diversity: distinct top terms by all top terms.
    """
    n, share = F.col("topic_size"), F.col("topic_share_non_outlier_exact")
    whole = topics.groupBy(*group).agg(F.sum("topic_size").alias("_all"))
    rows = join_bounded(topics, whole, group).withColumn("topic_share_non_outlier_exact", n / F.col("_all"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("topic_size", "topic"))  # topics of one group
    rows = rows.withColumn("_i", place)
    count, total = F.count(F.lit(1)), F.sum(n)
    entropy = -F.sum(share * F.log(share))
    facts = rows.groupBy(*group).agg(
        count.alias("n_topics_non_outlier"), F.max(n).alias("largest_topic_size"), F.round(F.max(share), 6).alias("largest_topic_share_non_outlier"), F.round(F.avg(n), 6).alias("mean_topic_size"), F.round(F.percentile(n, 0.5), 6).alias("median_topic_size"),
        F.round(F.percentile(n, 0.9), 6).alias("p90_topic_size"), F.round(entropy, 6).alias("topic_size_entropy"), F.round(F.exp(entropy), 6).alias("effective_number_of_topics"), F.round(F.sum(share * share), 6).alias("topic_size_hhi"),
        F.round((2 * F.sum(F.col("_i") * n) / (count * total)) - (count + 1) / count, 6).alias("topic_size_gini"), F.round(F.avg("coherence_npmi"), 6).alias("mean_coherence_npmi"), F.round(F.avg("coherence_cv"), 6).alias("mean_coherence_cv"), F.count_if("is_flagged_for_review").alias("flagged_topics"),
    )
    words = topic_terms.groupBy(*group).agg(F.round(F.count_distinct("term") / F.count(F.lit(1)), 6).alias("topic_diversity"))
    pairs = overlaps.groupBy(*group).agg(F.count(F.lit(1)).alias("high_overlap_pair_count"))
    return facts.join(words, group, "left").join(pairs, group, "left").fillna(0, ["high_overlap_pair_count"])
