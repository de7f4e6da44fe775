"""URL filter (op10): rules first, then naive Bayes over words of the host and the path.

Concatenated host names are split by the most likely sequence of words under a unigram model (Viterbi), whose counts
come from all pages' visible text. Only the substrings of the distinct host parts are looked up in it, by a join, so
the vocabulary is never sent around. A multinomial naive Bayes classifier over segmented host and path tokens learns
from the pages that a rule fits, with the rule's verdict as label, and judges the pages that none fits; hosts and paths
that rules name are no tokens of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

# Rules as (host and path, verdict).
RULES: list[tuple[str, str]] = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: No label of a host name is longer, so a longer run of letters is one word.
LONGEST_LABEL = 63
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lowered. NULL or no ://: empty."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (of equal ones the first), as a struct of rule and verdict; NULL if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_parts(host: Column) -> Column:
    """Runs of letters of a host."""
    return F.filter(F.split(host, r"[^a-z]+"), lambda p: p != "")


def path_tokens(path: Column) -> Column:
    """Runs of letters of a path, lowered; a run of digits is one token whatever the number."""
    plain = F.regexp_replace(F.translate(path, _UPPER, _LOWER), r"[0-9]+", " 0 ")
    return F.filter(F.split(plain, r"[^a-z0]+"), lambda p: p != "")


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n over the visible text of all pages."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^a-z]+")).alias("word")).where(F.col("word") != "")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(part: str, known: dict[str, float], unknown: float) -> list[str]:
    """The most likely words; an unknown one of k letters has the log probability unknown - k * log 10."""
    if len(part) > LONGEST_LABEL:
        return [part]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(part) + 1):
        best.append(max((best[start][0] + known.get(part[start:end], unknown - (end - start) * math.log(10)), start) for start in range(end)))
    words, end = [], len(part)
    while end:
        start = best[end][1]
        words.append(part[start:end])
        end = start
    return words[::-1]


def segmented(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """part, words for each row of parts (part: distinct), by the unigram counts (word, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = parts.where(F.length("part") <= LONGEST_LABEL)
    starts = F.sequence(F.lit(1), F.length("part"))
    subs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("part") - i + 1), lambda k: F.substring(F.col("part"), i, k))))
    pieces = some.select("part", F.explode(F.array_distinct(subs)).alias("word"))
    used = pieces.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    known = runtime.stored(used.join(counts, "word"), "known-substrings")
    met = runtime.join_by_frequency(pieces, known, "word", "uses", max(1, parts.count() * LONGEST_LABEL))
    rows = parts.join(met.groupBy("part").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts")), "part", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, words, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = {w: math.log(n / total) for w, n in zip(words or [], ns or [], strict=True)}
                out.append(best_split(part, known, math.log(10 / total) if total else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["part", "words"])

    return rows.select("part", "words", "counts").mapInArrow(run, "part string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, host_words for each row of hosts (host: distinct, n_pages kept)."""
    each = hosts.select("host", F.posexplode(host_parts(F.col("host"))).alias("at", "part"))
    by_part = each.groupBy("part").agg(F.count(F.lit(1)).alias("n_hosts"))
    parts = runtime.stored(by_part, "host-parts")
    split = runtime.stored(segmented(parts.select("part"), counts).join(parts, "part"), "split-parts")
    joined = runtime.join_by_frequency(each, split, "part", "n_hosts", max(1, hosts.count()))
    words = joined.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    return hosts.join(words, "host", "left").select("host", "n_pages", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"))


def beside_rules(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Host and path without what rules can say: as many last labels of every host, and first segments of every path, as a
    rule has at most.

    For every page, whether a rule fits it or not, and as much of each, or else words of rules, or what is left beside a
    shorter rule, would tell labelled pages from the others and one verdict from the other.
    """
    most = max((r.partition("/")[0].count(".") + 1 for r, _ in rules), default=0)
    deepest = max((r.partition("/")[2].count("/") for r, _ in rules), default=0)
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    host = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - most, F.lit(0))), ".")
    # A path begins with a slash, before which is an empty segment.
    path = F.array_join(F.slice(segments, F.lit(deepest + 2), F.greatest(F.size(segments) - deepest - 1, F.lit(0))), "/")
    return host, path


def cross_scores(urls: DataFrame, folds: int = 5) -> DataFrame:
    """row, bad, score of the labelled rows of urls (row, tokens, bad), each by the counts of the other folds: held-out scores."""
    fold = F.pmod(F.xxhash64("row"), F.lit(folds)).cast("int")
    known = urls.where(F.col("bad").isNotNull()).select("row", "bad", "tokens", fold.alias("fold"))
    each = known.select("row", "bad", "fold", F.explode("tokens").alias("token"))
    counts = lambda df, *by: df.groupBy(*by).agg(F.sum("bad").alias("n_bad"), F.sum(1 - F.col("bad")).alias("n_good"))
    own = counts(each, "token", "fold").withColumnsRenamed({"n_bad": "own_bad", "n_good": "own_good"})
    total = counts(each, "token")
    sizes = {r.fold: (r.n_bad, r.n_good) for r in counts(each, "fold").collect()}  # a row per fold
    rows = {r.fold: (r.n_bad, r.n_good) for r in counts(known, "fold").collect()}
    out = [sum(v[k] for v in sizes.values()) for k in (0, 1)]
    pages = [sum(v[k] for v in rows.values()) for k in (0, 1)]
    kinds = total.count()
    at = lambda values: F.element_at(F.array(*[F.lit(float(values(f))) for f in range(folds)]), F.col("fold") + 1)
    bad_tokens, good_tokens = (at(lambda f, k=k: out[k] - sizes.get(f, (0, 0))[k] + kinds + 1) for k in (0, 1))
    prior = at(lambda f: math.log((pages[0] - rows.get(f, (0, 0))[0] + 1) / (pages[1] - rows.get(f, (0, 0))[1] + 1)))
    joined = each.select("row", "fold", "token").join(total, "token").join(own, ["token", "fold"])
    weight = F.log((F.col("n_bad") - F.col("own_bad") + 1.0) / bad_tokens) - F.log((F.col("n_good") - F.col("own_good") + 1.0) / good_tokens)
    odds = joined.groupBy("row").agg(F.sum(weight).alias("sum"))
    return known.join(odds, "row", "left").select("row", "bad", F.round(F.coalesce("sum", F.lit(0.0)) + prior, 9).alias("score"))


def labelled_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """row, page_id, host, path, fit (the rule), host_words, tokens and bad (1: a rule blocks, 0: allows, NULL: none fits); stored."""
    rules = RULES if rules is None else rules
    spark: SparkSession = pages.sparkSession
    runtime.prepare(spark)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    host, path = beside_rules(rules)
    rows = runtime.stored(rows.select("*", host.alias("own"), path.alias("own_path")).withColumn("row", F.monotonically_increasing_id()), "urls")
    total = rows.count()
    counts = runtime.stored(unigrams(pages), "unigrams")
    names = rows.select("host").unionByName(rows.select(F.col("own").alias("host")))
    hosts = runtime.stored(host_words(runtime.stored(names.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")), "hosts"), counts), "host-words")
    joined = runtime.join_by_frequency(rows, hosts, "host", "n_pages", 2 * total)
    own_words = hosts.select(F.col("host").alias("own"), F.col("host_words").alias("own_words"), "n_pages")
    joined = runtime.join_by_frequency(joined.drop("n_pages"), own_words, "own", "n_pages", 2 * total)
    tokens = F.concat(F.transform("own_words", lambda w: F.concat(F.lit("h:"), w)), F.transform(path_tokens(F.col("own_path")), lambda w: F.concat(F.lit("p:"), w)))
    label = F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    return runtime.stored(joined.select("row", "page_id", "host", "path", "fit", "host_words", tokens.alias("tokens"), label.alias("bad")), "url-tokens")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block) and host_words for every row of pages.

    A NULL or malformed url has an empty host and path and no tokens, so the prior decides. Even odds, and all odds where
    no rule blocks or none allows any page, mean allow. Repeated rows count as often as they occur.
    """
    urls = labelled_urls(pages, rules)
    size = F.size("tokens")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("bad"), 1 - F.col("bad"), F.col("bad") * size, (1 - F.col("bad")) * size, size)]
    bad, good, bad_tokens, good_tokens, n_tokens = urls.agg(*sums).first()
    each = urls.select("row", "bad", F.explode("tokens").alias("token"))
    by_token = runtime.stored(each.groupBy("token").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("n_good"), F.count(F.lit(1)).alias("n")), "url-token-counts")
    kinds = by_token.where("n_bad + n_good > 0").count()
    weight = F.log((F.col("n_bad") + 1.0) / (bad_tokens + kinds + 1.0)) - F.log((F.col("n_good") + 1.0) / (good_tokens + kinds + 1.0))
    scored = runtime.join_by_frequency(each.select("row", "token"), by_token.select("token", "n", weight.alias("weight")), "token", "n", max(1, n_tokens))
    odds = scored.groupBy("row").agg(F.sum("weight").alias("sum"))
    prior = math.log((bad + 1) / (good + 1))
    out = urls.join(odds, "row", "left").withColumn("score", F.round(F.coalesce("sum", F.lit(0.0)) + prior, 9))
    learned = F.when((F.col("score") > 0) & F.lit(bad > 0 and good > 0), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), learned).alias("verdict"), "score", F.array_join("host_words", " ").alias("host_words"))
