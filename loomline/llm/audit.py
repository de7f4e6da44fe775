"""Filter interaction audit (op11): what each filter removes in every order in which a set of filters can be applied.

Documents are counted by mask cells: a part (language, source) and the set of filters that a document fails, as bits. A
cell is unpivoted against the steps of all orders; a running bit-or over the steps before says whether an earlier filter
had removed it already, and conditional sums of the cells' counts are the figures. What reaches these windows is bounded
by parts and filters, whatever the number of documents.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runtime

#: Bit k of a mask is set if the document fails the filter with letter k.
FILTERS = "ABCDE"
# Fixed values of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, FORBIDDEN = 200, 50, 3, "[#$%&*|]"
_SPACE = " \t\n\x0b\x0c\r"


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at a text alone: A few words, B few distinct ones, C many capitals, D forbidden signs."""
    inner = F.btrim(text, F.lit(_SPACE))
    words = F.split(inner, r"[\x20\x09-\x0D]+")  # of an empty text one empty word, which no test below sees
    n = F.when(inner == "", 0).otherwise(F.size(words))
    few = n < LEAST_WORDS
    repeated = 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text)
    forbidden = text.rlike(FORBIDDEN)
    return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate((few, repeated, capitals, forbidden))), F.lit(0))


def labels_by_id(labels: DataFrame) -> DataFrame:
    """A row per labelled doc_id: good (some row has quality 1), toxic (some row has toxic 1)."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, n_good, n_toxic: how many documents fail just the filters of a mask.

    A document fails E if a smaller doc_id has an identical text (by SHA-256 of the whole text). A NULL text is empty, a
    NULL part the empty string. Rows that repeat a doc_id and its text are documents that don't count as smaller than
    each other; a row without a doc_id has no smaller one and is none. Copies and repeated rows are added up before
    anything is joined, so no key holds them all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    slim = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask"))
    slim = runtime.stored(slim.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    known, nameless = slim.where(F.col("doc_id").isNotNull()), slim.where(F.col("doc_id").isNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = known.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << 4))).drop("first")
    known = runtime.join_bounded(known, runtime.stored(labels_by_id(labels), "audit-labels"), ["doc_id"], "left")
    nameless = nameless.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("n_good"), count("toxic").alias("n_toxic"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of all filters (their letters) and step, from 1, with what its filter does there.

    kept: documents left after the step. removed: those that it removes. redundant: those that fail its filter but were
    removed before. unique_fails: those that fail its filter alone. good_lost, toxic_lost: removed ones with the label.
    shapley: removed by its filter, summed over all orders. A part has a row for every order and step, zeros included;
    without cells there are no rows.
    """
    orders = ["".join(p) for p in itertools.permutations(filters)]
    bit = sum((F.when(F.col("filter") == letter, 1 << k).otherwise(0) for k, letter in enumerate(filters)), F.lit(0))
    long = cells.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("pos", "filter"))
    long = long.withColumn("step", F.col("pos") + 1).withColumn("bit", bit).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, reached = F.col("failed") != 0, F.col("earlier") == 0
    total = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(reached & fails, "n_good").alias("good_lost"),
        total(reached & fails, "n_toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
