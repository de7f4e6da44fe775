"""Quality by compression (op4): zstandard dictionaries of good and of bad labelled text.

A text is compressed in blocks with either dictionary; the normalised difference of the two sizes (by the smaller one
and by the bytes of the text) says which of them knows the text better, and a logistic function calibrates it to
P(label 1).

The classifier is fitted on a bounded sample of labelled rows (SAMPLE_PER_LABEL rows of either label, two thirds of them
for the dictionaries and one third for the calibration, and of the former as many, in a hash order, as SAMPLE_BYTES
hold), whose texts are taken whole, in blocks; every whole text is scored. As the sample is drawn by label, the
calibration is corrected to the rate of label 1 among all labelled documents, which is counted.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import labels as labelled
from . import runtime
from .calibrate import Logistic

MOD, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Labelled rows of either label that the fit reads.
SAMPLE_PER_LABEL = 3000
#: Bytes of sampled rows of a label that train its dictionary: rows beyond them are left out, never cut.
SAMPLE_BYTES = 12_000_000
#: Bytes of a dictionary; bytes compressed at once.
DICTIONARY_BYTES, BLOCK = 112_640, 2048
LEVEL = 3


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or plain content where there is too little text to train one."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-size:]


@dataclasses.dataclass
class Model:
    good: bytes
    bad: bytes
    calibration: Logistic | None = None

    def __post_init__(self) -> None:
        self._compressors = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_compressors": None}

    def sizes(self, text: str) -> tuple[int, int, int]:
        """Bytes of the text, and compressed with the good and the bad dictionary."""
        if self._compressors is None:
            self._compressors = []
            for content in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(content)
                if content:
                    known.precompute_compress(LEVEL)
                    self._compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
                else:
                    self._compressors.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        good, bad = self._compressors
        raw = text.encode("utf-8", "surrogatepass")
        g = b = 0
        for i in range(0, len(raw), BLOCK):
            block = raw[i : i + BLOCK]
            g += len(good.compress(block))
            b += len(bad.compress(block))
        return len(raw), g, b

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        n, g, b = np.maximum(sizes, 1).astype(float).T
        least = np.minimum(g, b)
        return np.stack([(b - g) / least, (b - g) / n], axis=1)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and scores; an empty text has the base rate as its score."""
        sizes = np.array([self.sizes(t) for t in texts], np.int64).reshape(-1, 3)
        scores = self.calibration(self.features(sizes)) if len(texts) else np.empty(0)
        return sizes, np.where(sizes[:, 0] > 0, scores, self.calibration.base())


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", mod: int = MOD, held_out: int = HELD_OUT, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Dictionaries and calibration from labelled rows outside the held-out fold.

    NULL and empty texts and NULL ids teach nothing; rows that repeat a labelled doc_id are read each, equal texts of it once. Without rows of a
    label its dictionary is empty, without any the score is 0.5.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    rows = runtime.stored(labelled.usable(labels, column, mod, held_out), "quality-labels")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    counts = {r[0]: r[1] for r in runtime.join_bounded(ids, rows, ["doc_id"], "inner").groupBy("label").count().collect()}  # two rows
    rate = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    chosen = [labelled.hashed_sample(rows.where(F.col("label") == k), per_label, 4) for k in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # at most 2 * per_label rows
    texts = runtime.docs_of(docs).join(F.broadcast(sample), "doc_id").where(F.col("text") != "")
    texts = runtime.stored(texts.withColumn("use", (F.abs(F.xxhash64("doc_id", F.lit(44))) % 3 < 2).cast("int")).withColumn("key", F.xxhash64("doc_id", "text")), "quality-sample")
    # Rows for the dictionaries: whole texts in a hash order, as long as all before them fit in the bytes. Sizes alone are ordered.
    sizes = texts.where("use = 1").select("label", "doc_id", "key", F.octet_length("text").cast("long").alias("size")).distinct()
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(45)), "doc_id", "key")  # at most per_label rows, but for repeated ids
    fitting = sizes.withColumn("through", F.sum("size").over(before)).where(F.col("through") <= SAMPLE_BYTES).select("label", "doc_id", "key")
    rows = texts.where("use = 1").join(fitting, ["label", "doc_id", "key"]).select("label", "text", "doc_id").distinct().orderBy("label", "doc_id", "text").collect()
    dictionaries = [build_dictionary([raw[i : i + BLOCK] for r in rows if r[0] == k for raw in [r[1].encode("utf-8", "surrogatepass")] for i in range(0, len(raw), BLOCK)]) for k in (0, 1)]
    model = Model(dictionaries[1], dictionaries[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([model.sizes(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sizes.T)], ["label", "n", "g", "b"])

    measured = texts.where("use = 0").select("label", "text").mapInArrow(runtime.tidy(measure), "label int, n long, g long, b long").orderBy("label", "n", "g", "b").collect()
    values = np.array([tuple(r) for r in measured], np.int64).reshape(-1, 4)
    model.calibration = Logistic(Model.features(values[:, 1:]), values[:, 0], rate=rate)
    return model


def score(docs: DataFrame, model: Model, mod: int = MOD, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """Every whole text's score. A NULL text is empty; NULL and repeated doc_ids are rows like any other."""
    runtime.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, scores = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(sizes[:, 1]), pa.array(sizes[:, 2])], ["doc_id", "score", "good_bytes", "bad_bytes"])

    out = runtime.docs_of(docs).mapInArrow(runtime.tidy(run), "doc_id long, score double, good_bytes long, bad_bytes long")
    return out.select("doc_id", (runtime.fold_of(F.col("doc_id"), mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "good_bytes", "bad_bytes")


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, all columns, whose text scores at least `least`. A NULL text is empty: the base rate is its score. Equal texts go or stay together."""
    runtime.prepare(docs.sparkSession)

    def run(batches):
        import pandas as pd

        for texts in batches:
            yield pd.Series(model.score(["" if t is None else t for t in texts])[1])

    value = F.pandas_udf(runtime.tidy(run), "double", F.PandasUDFType.SCALAR_ITER)
    return docs.where(value(F.col("text")) >= least)
