"""Benchmark decontamination (op8) by a distributed positional inverted index; DataFrame functions only.

The index holds (row, position) for every occurrence, in the training texts, of a term that some benchmark item has; it
is written once, by the tasks that read the texts and without a shuffle. A phrase is looked up from its rarest term on:
the lists of its two rarest terms, adjusted by their offsets in the phrase, are intersected first, then those of the
others, for the places that are left. All phrases are looked up at once.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime

WINDOW = 10
#: Terms of all items up to which the texts' words meet them by broadcast; beyond, by a shuffle.
BROADCAST_TERMS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP_SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def raw_words(text: Column) -> Column:
    """Runs of signs other than 00-2F, 3A-60 and 7B-7F, where A-Z count as a-z; not yet lowered."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_GAP_SIGNS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def lowered(text: Column) -> Column:
    """A-Z alone, as the contract of words has it."""
    return F.translate(text, _UPPER, _LOWER)


@dataclasses.dataclass
class Index:
    """postings: row, doc_id, term, pos; term -1: pos is the row's number of words. terms: word, term. frequencies: term, frequency."""

    postings: DataFrame
    terms: DataFrame
    frequencies: DataFrame

    def sizes(self) -> DataFrame:
        return self.postings.where(F.col("term") == -1).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def build_index(docs: DataFrame, words: DataFrame) -> Index:
    """Postings of the given words (word: distinct, lowered) in all whole texts. A NULL text has no words."""
    spark = docs.sparkSession
    terms = runtime.stored(words.select("word", F.monotonically_increasing_id().alias("term")), "terms")
    # Lowered as a whole the words meet the terms, then A-Z alone decide; most words have no other capitals anyway.
    by_key = runtime.stored(terms.groupBy(F.lower("word").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("word", "term"))).alias("found")), "term-keys")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw_words(F.col("text")).alias("words"))
    # The number of words rides with the last word; a text without words has one empty word, which meets no term.
    every = rows.select("row", "doc_id", F.posexplode(F.array_append("words", F.lit(""))).alias("pos", "raw")).withColumn("key", F.lower("raw"))
    own = by_key.unionByName(spark.range(1).select(F.lit("").alias("key"), F.create_map(F.lit(""), F.lit(-1).cast("long")).alias("found")))
    if by_key.count() < BROADCAST_TERMS:
        met = every.join(F.broadcast(own), "key")
    else:
        words_only = runtime.join_skewed(every.where(F.col("raw") != ""), by_key, "key", BROADCAST_TERMS)
        met = words_only.unionByName(every.where(F.col("raw") == "").withColumn("found", F.create_map(F.lit(""), F.lit(-1).cast("long"))))
    postings = met.select("row", "doc_id", F.try_element_at("found", lowered(F.col("raw"))).alias("term"), "pos").where(F.col("term").isNotNull())
    postings = runtime.stored(postings, "postings")
    frequencies = postings.where(F.col("term") >= 0).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    return Index(postings, terms, runtime.stored(frequencies, "term-frequencies"))


def windows_of(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase, words) of width consecutive words, or all of a shorter item, and the items of each (phrase, item_id)."""
    words = items.select("item_id", F.transform(raw_words(F.col("text")), lowered).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    every = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(width)))).alias("words"))
    phrases = runtime.stored(every.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return phrases, runtime.stored(every.join(phrases, "words").select("phrase", "item_id").distinct(), "phrase-items")


def phrase_terms(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase, term, offset, length, rank (1: the rarest in the texts), for phrases all of whose terms occur."""
    each = phrases.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    known = index.terms.join(index.frequencies, "term", "left")
    each = runtime.join_skewed(each, known, "word", BROADCAST_TERMS, index.terms.count())
    own = Window.partitionBy("phrase")
    ranked = each.withColumn("least", F.min(F.coalesce("frequency", F.lit(0))).over(own)).where(F.col("least") > 0)
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy("frequency", "offset")))
    return runtime.stored(ranked.select("phrase", "term", "offset", "length", "rank", "frequency"), "phrase-terms")


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """row, phrase, start, length of every exact occurrence."""
    wanted = phrase_terms(index, phrases)
    postings = index.postings.where(F.col("term") >= 0).select("row", "term", "pos")
    by_term = wanted.where(F.col("rank") <= 2).groupBy("term").agg(F.first("frequency").alias("frequency"), F.collect_list(F.struct("phrase", "offset", "length")).alias("uses"))
    by_term = runtime.stored(by_term, "rare-terms")
    if by_term.count() <= BROADCAST_TERMS:
        rarest = postings.join(F.broadcast(by_term), "term")
    else:
        rarest = runtime.join_by_frequency(postings, by_term, "term", "frequency", by_term.agg(F.sum("frequency")).first()[0])
    rarest = rarest.select("row", "pos", F.inline("uses"))
    places = rarest.groupBy("row", "phrase", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"))
    places = runtime.stored(places.where((F.col("n") == F.least("length", F.lit(2))) & (F.col("start") >= 0)).select("row", "phrase", "start", "length"), "phrase-places")
    done = places.where(F.col("length") <= 2)
    others = wanted.where(F.col("rank") > 2).select("phrase", "term", "offset")
    probes = runtime.join_bounded(places.where(F.col("length") > 2), others, ["phrase"], "inner")
    probes = probes.select("row", "phrase", "start", "length", "term", (F.col("start") + F.col("offset")).alias("pos"))
    # Only the rows that have a place left, which most rows don't.
    near = runtime.join_bounded(postings, runtime.stored(places.select("row").distinct(), "phrase-rows"), ["row"], "left_semi")
    found = probes.join(near, ["row", "pos", "term"]).groupBy("row", "phrase", "start").agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"))
    return done.unionByName(found.where(F.col("n") == F.col("length") - 2).select("row", "phrase", "start", "length"))


def proximity_matches(index: Index, phrases: DataFrame, slop: int) -> DataFrame:
    """row, phrase, anchor of places where each term of a phrase stands within slop words of where the phrase has it.

    anchor is where the phrase would begin by its rarest term. Positions are compared by cells of slop + 1, each term
    posting to the cells it can be near to, so that the join is by equality.
    """
    wanted = phrase_terms(index, phrases)
    postings = index.postings.where(F.col("term") >= 0).select("row", "term", "pos")
    by_term = wanted.groupBy("term").agg(F.first("frequency").alias("frequency"), F.collect_list(F.struct("phrase", "rank", "length", "offset")).alias("uses"))
    total = by_term.agg(F.coalesce(F.sum("frequency"), F.lit(0))).first()[0]
    shifted = runtime.join_by_frequency(postings, by_term, "term", "frequency", total).select("row", "pos", F.inline("uses")).select("row", "phrase", "rank", "length", (F.col("pos") - F.col("offset")).alias("start"))
    cell = F.floor(F.col("start") / (slop + 1)).cast("long")
    anchors = shifted.where(F.col("rank") == 1).select("row", "phrase", "length", F.col("start").alias("anchor"), cell.alias("cell"))
    around = shifted.select("row", "phrase", "rank", "start", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = anchors.join(around, ["row", "phrase", "cell"]).where(F.abs(F.col("start") - F.col("anchor")) <= slop)
    return near.groupBy("row", "phrase", "anchor").agg(F.count_distinct("rank").alias("n"), F.first("length").alias("length")).where(F.col("n") == F.col("length")).select("row", "phrase", "anchor")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """A row per row of docs: n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated.

    An item without words has no window, and one without an item_id marks words but is no item. Items that repeat an
    item_id are one. NULL and repeated doc_ids are rows like any other.
    """
    phrases, owners = windows_of(items, width)
    index = build_index(docs, phrases.select(F.explode("words").alias("word")).distinct())
    matches = runtime.stored(phrase_matches(index, phrases), "matches")
    spans = matches.select("row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = spans.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = runtime.join_bounded(matches.select("row", "phrase").distinct(), owners, ["phrase"], "inner").select("row", F.col("item_id").cast("string").alias("item"))
    listed = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select("row", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = index.sizes().join(hits, "row", "left").join(listed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows, all columns, without any occurrence of a benchmark window.

    Rows are told apart by a 64-bit hash of doc_id and text, so rows with a NULL or a repeated doc_id go or stay by their
    own texts, and rows equal in both go or stay together. A NULL text is empty, and clean.
    """
    name = "__loomline_key"
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = contamination(docs.select(key.alias("doc_id"), "text"), items, width).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return runtime.join_bounded(docs.withColumn(name, key), runtime.stored(found, "contaminated-rows"), [name], "left_anti").drop(name)
