"""Toxicity by nearest labelled examples (op2): exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings of 4 to 6 letters (for endings vary). From a bounded sample of labelled rows
(MAX_EXAMPLES) come the examples and all terms whose presence depends on the label (chi-square); inverse document
frequencies of these terms are counted over all documents. The index keeps postings by term and block of 64 examples,
with the largest weight in each; a query first reads the blocks of the highest upper bounds, then those whose bound
still reaches the k-th best similarity found, and no others, so the k nearest in the space of those terms are exact. Votes weigh by distance, shrink to the rate among
texts without any such term, and are calibrated on the examples, each without itself. The nearest are the evidence.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as labelled
from . import runtime
from .calibrate import Logistic

MOD, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled rows that the fit reads; nearest examples that vote.
MAX_EXAMPLES, NEIGHBOURS = 12_000, 15
#: A term counts if so many examples have it and its chi-square is so high: a rule, whatever the number of terms.
LEAST_COUNT, LEAST_CHI2 = 3, 20.0
BLOCK = 64
_WORD = re.compile(r"[^\W_]+")
_BEGINNINGS = (4, 5, 6)


def terms_of(text: str) -> Counter:
    """How often the text has each word, and each beginning of a longer word (marked by a hyphen)."""
    out = Counter(_WORD.findall(text.lower()))
    for word, n in list(out.items()):
        for k in _BEGINNINGS:
            if len(word) > k:
                out[word[:k] + "-"] += n
    return out


class BlockMaxIndex:
    """Examples as sparse unit vectors over V terms; search gives the exact k nearest by cosine."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        self.n = len(rows)
        self.blocks = max(1, -(-self.n // BLOCK))
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in rows]) if rows else np.empty(0, int)
        term = np.concatenate([t for t, _ in rows]) if rows else np.empty(0, int)
        weight = np.concatenate([w for _, w in rows]) if rows else np.empty(0)
        order = np.lexsort((example, term))
        self.example, self.weight, term = example[order], weight[order], term[order]
        self.bound = np.zeros((n_terms, self.blocks))
        cell = term * self.blocks + self.example // BLOCK
        np.maximum.at(self.bound.reshape(-1), cell, self.weight)
        self.start = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))  # of each term's postings in each block

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Exact similarities of the examples in the given blocks, 0 elsewhere; only their postings are read."""
        cell = (terms[:, None] * self.blocks + blocks).reshape(-1)
        first, n = self.start[cell], self.start[cell + 1] - self.start[cell]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        share = np.repeat(np.repeat(weights, len(blocks)), n)
        return np.bincount(self.example[at], share * self.weight[at], minlength=self.n)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nearest examples of positive similarity, nearest first (ties: the earlier one), and the similarities."""
        bound = weights @ self.bound[terms]
        order = np.argsort(-bound, kind="stable")
        first = order[: max(4, 2 * k // BLOCK + 1)]
        done = np.zeros(self.blocks, bool)
        done[first] = True
        scores = self._scores(terms, weights, first)
        if without >= 0:
            scores[without] = 0
        positive = scores[scores > 0]
        least = np.partition(positive, -k)[-k] if len(positive) >= k else 0.0
        more = (bound > 0) & (bound >= least - 1e-12) & ~done
        if more.any():  # only blocks that can hold one of the k nearest
            scores += self._scores(terms, weights, np.flatnonzero(more))
            if without >= 0:
                scores[without] = 0
        hit = np.flatnonzero(scores > 0)
        top = hit[np.lexsort((hit, -np.round(scores[hit], 12)))[:k]]
        return top, scores[top]


@dataclasses.dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: list[int]
    labels: np.ndarray
    index: BlockMaxIndex
    rate: float  # of label 1 among examples without any term
    calibration: Logistic | None = None
    k: int = NEIGHBOURS

    def __post_init__(self) -> None:
        self._seen: dict = {}
        self._heads = {t[: _BEGINNINGS[0]] for t in self.vocabulary}  # most words share their first letters with no term

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_seen": {}}

    def forget(self) -> None:
        """Drops the scores that are kept of texts seen before."""
        self._seen.clear()

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        return _unit({self.vocabulary[t]: n for t, n in counts.items() if t in self.vocabulary}, self.idf)

    def known_terms(self, text: str) -> dict[int, int]:
        """terms_of, only those of the vocabulary."""
        found: dict[int, int] = {}
        vocabulary, heads = self.vocabulary, self._heads
        for word, n in Counter(_WORD.findall(text.lower())).items():
            if word[: _BEGINNINGS[0]] not in heads:
                continue
            if word in vocabulary:
                found[vocabulary[word]] = n
            for k in _BEGINNINGS:
                if len(word) > k and (t := vocabulary.get(word[:k] + "-")) is not None:
                    found[t] = found.get(t, 0) + n
        return found

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float, list[tuple[int, float, int]]]:
        """The distance-weighted share of label 1 among the nearest, and these: doc_id, similarity, label."""
        if not len(terms):
            return self.rate, []
        near, sims = self.index.search(terms, weights, self.k, without)
        pull = 1 / (1.05 - np.minimum(sims, 1))
        share = (pull @ self.labels[near] + self.rate) / (pull.sum() + 1)
        return float(share), [(self.ids[i], float(s), int(self.labels[i])) for i, s in zip(near, sims, strict=True)]

    def score(self, text: str) -> tuple[float, list[tuple[int, float, int]]]:
        found = self.known_terms(text)
        key = tuple(sorted(found.items()))
        if key not in self._seen:
            if len(self._seen) > 50_000:
                self._seen.clear()
            share, near = self.vote(*_unit(found, self.idf))
            value = float(self.calibration(_odds(np.array([share])))[0]) if self.calibration else share
            self._seen[key] = (value, near)
        return self._seen[key]


def _unit(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.array(sorted(counts), int)
    weights = (1 + np.log(np.array([counts[t] for t in terms], float))) * idf[terms] if len(terms) else np.empty(0)
    norm = np.sqrt(weights @ weights)
    return terms, weights / norm if norm else weights


def _odds(share: np.ndarray) -> np.ndarray:
    p = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))[:, None]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", mod: int = MOD, held_out: int = HELD_OUT, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """Terms, examples and calibration from labelled rows outside the held-out fold; document frequencies from all documents.

    NULL texts are empty; NULL doc_ids have no label. Rows that repeat a text are one example, which stands for none if
    their labels differ; all rows count for document frequencies. Without examples the score is that of an empty text.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    texts = runtime.docs_of(docs)
    sample = labelled.hashed_sample(labelled.usable(labels, column, mod, held_out), max_examples, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [terms_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                ["doc_id", "label", "terms", "counts"],
            )

    chosen = texts.join(F.broadcast(sample), "doc_id")  # sample: at most max_examples rows
    # One example for each text, or copies would make any of its words look like a sign of its label.
    once = chosen.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("label").alias("label"), F.max("label").alias("most"))
    chosen = once.where(F.col("label") == F.col("most")).select("doc_id", "text", "label")
    rows = runtime.stored(chosen.mapInArrow(runtime.tidy(count), "doc_id long, label int, terms array<string>, counts array<int>"), "toxicity-sample")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    by_term = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("a"))
    a, m = F.col("a").cast("double"), F.col("n").cast("double")
    # Chi-square of a two by two table: with the term and without it, label 1 and label 0.
    spread = m * (n - m) * float(ones) * float(n - ones)
    chi2 = F.pow(a * float(n) - m * float(ones), 2) * float(n) / F.nullif(spread, F.lit(0.0))
    kept = by_term.where(m >= LEAST_COUNT).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    vocabulary = {r[0]: i for i, r in enumerate(sorted(kept.select("term").collect()))}
    model = Model(vocabulary, np.ones(len(vocabulary)), [], np.empty(0), BlockMaxIndex([], len(vocabulary)), 0.0, k=k)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_docs = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n_docs += 1
                for t in model.known_terms(text):
                    found[t] += 1
        found[-1] = n_docs
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "n"])

    counted = texts.select("text").mapInArrow(runtime.tidy(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per kept term
    df = np.zeros(len(vocabulary) + 1)
    for r in counted:
        df[r[0]] = r[1]
    model.idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    matched = F.filter(F.arrays_zip("terms", "counts"), lambda x: x["terms"].isin(list(vocabulary))) if vocabulary else F.array()
    examples = sorted(rows.select("doc_id", "label", matched.alias("m")).collect(), key=lambda r: (r[0], r[1]))  # at most max_examples rows
    vectors = [model.vector({x[0]: x[1] for x in r[2]}) for r in examples]
    empty = np.array([len(t) == 0 for t, _ in vectors], bool)
    y = np.array([r[1] for r in examples], float)
    model.rate = float((y[empty].sum() + 0.5) / (empty.sum() + 10)) if len(y) else 0.05
    with_terms = [i for i in range(len(vectors)) if not empty[i]]
    model.ids, model.labels = [examples[i][0] for i in with_terms], y[with_terms]
    model.index = BlockMaxIndex([vectors[i] for i in with_terms], len(vocabulary))
    place = {i: j for j, i in enumerate(with_terms)}
    votes = np.array([model.vote(*vectors[i], without=place.get(i, -1))[0] for i in range(len(vectors))])
    model.calibration = Logistic(_odds(votes) if len(votes) else np.empty((0, 1)), y)
    return model


def score(docs: DataFrame, model: Model, mod: int = MOD, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """Every whole text's score with the nearest examples that voted (doc_id:similarity:label).

    A NULL text is empty: the score of a text without terms. NULL and repeated doc_ids are rows like any other.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            near = ["; ".join(f"{i}:{s:.4f}:{y}" for i, s, y in e) for _, e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(near, pa.string())], ["doc_id", "score", "evidence"])

    out = runtime.docs_of(docs).mapInArrow(runtime.tidy(run, lambda: shared.value.forget()), "doc_id long, score double, evidence string")
    return out.select("doc_id", (runtime.fold_of(F.col("doc_id"), mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold. A NULL text is empty, and so clean. Equal texts go or stay together."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pandas as pd

        for texts in batches:
            yield pd.Series([shared.value.score("" if t is None else t)[0] for t in texts], dtype="float64")

    value = F.pandas_udf(runtime.tidy(run, lambda: shared.value.forget()), "double", F.PandasUDFType.SCALAR_ITER)
    return docs.where(value(F.col("text")) < threshold)
