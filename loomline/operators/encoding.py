"""Texts to vectors with a model that the user brings, one per worker process.

Texts of a batch go to the model by their length in tokens, so that a call holds texts of about equal length, and come
back in the order of the rows. A vector depends on its text alone, not on the batch or partition it was in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
_models: dict[str, Encoder] = {}
_WORD = re.compile("[a-z]+")


class HashingEncoder:
    """Signed counts of words by a hash, as unit vectors: what stands in for a model where there is none.

    A word is a run of a-z of at least three letters of the lower-cased text. The lower half of its MD5 chooses the place,
    the upper half the sign. A text without words is the zero vector.
    """

    def __init__(self, dims: int) -> None:
        self.dims, self._places = dims, {}

    def _place(self, word: str) -> tuple[int, int]:
        if word not in self._places:
            digest = hashlib.md5(word.encode()).digest()
            self._places[word] = (int.from_bytes(digest[8:], "little") % self.dims, 1 - 2 * (int.from_bytes(digest[:8], "little") % 2))
            if len(self._places) > 500_000:
                self._places.clear()
                return self._place(word)
        return self._places[word]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for word in _WORD.findall(text.lower()):
                if len(word) >= 3:
                    place, sign = self._place(word)
                    row[place] += sign
        norms = np.sqrt((out * out).sum(1))
        return out / np.where(norms == 0, 1, norms)[:, None]


def model_of(name: str, load: Callable[[], Encoder]) -> Encoder:
    """The process's model of a name, loaded when it is first wanted."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def in_buckets(texts: list[str], encode: Encoder, dims: int, most: int) -> np.ndarray:
    """The vectors of the texts in their order; each call gets at most so many, of neighbouring lengths."""
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i].split()), i))
    out = np.empty((len(texts), dims))
    for begin in range(0, len(order), most):
        some = order[begin : begin + most]
        vectors = np.asarray(encode([texts[i] for i in some]), float)
        if vectors.shape != (len(some), dims):
            raise ValueError(f"the model gave vectors of shape {vectors.shape}, not {(len(some), dims)}")
        out[some] = vectors
    return out


def encode_texts(rows: DataFrame, key: str, text: str, name: str, load: Callable[[], Encoder], dims: int, batch: int = 32) -> DataFrame:
    """key and vector of every row. load makes the model, name tells models apart; a NULL text is empty."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(name, load)
        for part in batches:
            vectors = in_buckets(part.column(1).to_pylist(), model, dims, batch)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dims), pa.int32()), pa.array(vectors.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "vector"])

    return rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, f"`{key}` {kind}, vector array<double>")
