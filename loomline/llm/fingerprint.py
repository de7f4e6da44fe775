"""Document fingerprints (op6): one-permutation MinHash with optimal densification, low-order bits packed.

The hashes of a text's five-word shingles are binned once; a bin keeps its least hash. An empty bin takes the value of
a bin drawn by a hash of its own number and the attempt, again until that one isn't empty (optimal densification).
Of each value the lowest BITS bits are kept. Two fingerprints agree by chance in 2^-BITS of their bins, which the
likeness corrects: (share of equal bins - c) / (1 - c), cut to 0..1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import WordHashes, mix, shingle_hashes, words_of

BINS, BITS = 512, 4
_ATTEMPTS = 64


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS) -> None:
        self.bins, self.bits = bins, bits
        self._hashes = WordHashes()
        self._drawn: dict[int, np.ndarray] = {}

    def _draws(self, first: int) -> np.ndarray:
        """For attempts from first on and every bin: the bin to take from. The first ones, which most texts need, are kept."""
        if first not in self._drawn:
            if first >= 64 * _ATTEMPTS:
                return self._draw(first)
            self._drawn[first] = self._draw(first)
        return self._drawn[first]

    def _draw(self, first: int) -> np.ndarray:
        attempt = np.arange(first, first + _ATTEMPTS, dtype=np.uint64)[:, None]
        return (mix(attempt * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.bins, dtype=np.uint64)) % np.uint64(self.bins)).astype(np.int64)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """Each bin's low-order bits, from shingle hashes that may repeat; no shingle: no value."""
        if not len(shingles):
            return np.empty(0, np.uint8)
        at = (shingles % np.uint64(self.bins)).astype(np.int64)
        least = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, at, mix(shingles))
        filled = np.zeros(self.bins, bool)
        filled[at] = True
        empty = np.flatnonzero(~filled)
        if filled.sum() == 1:
            least[empty] = least[filled][0]
            empty = empty[:0]
        first = 0
        while len(empty):
            draws = self._draws(first)[:, empty]
            hit = filled[draws]
            found = hit.any(0)
            source = draws[hit.argmax(0), np.arange(len(empty))]
            least[empty[found]] = least[source[found]]
            empty = empty[~found]
            first += _ATTEMPTS
        return (mix(least) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def words(self, text: str) -> np.ndarray:
        """Hashes of the text's words, in order."""
        return self._hashes.of(words_of(text))

    def of_text(self, text: str) -> np.ndarray:
        return self.values(shingle_hashes(self.words(text)))

    def edited_words(self, text: str, words: np.ndarray, following: str) -> np.ndarray:
        """words of edited(text, following); only those after the last white space before the cut are hashed."""
        k = len(text) // 4
        cut = len(text) - k
        space = max(text.rfind(c, 0, cut) for c in " \t\n\v\f\r") + 1
        kept = len(words) - len(words_of(text[space:]))
        return np.concatenate([words[:kept], self.words(text[space:cut] + following[:k])])

    def packed(self, values: np.ndarray) -> str:
        """Hexadecimal; a text without words has the empty fingerprint."""
        if not len(values):
            return ""
        bits = (values[:, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        return np.packbits(bits.reshape(-1), bitorder="little").tobytes().hex()

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Of two texts without words 1, of one such 0."""
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many (or all) from the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """A row per document, with the likeness to its edited text and to the next document in ascending doc_id.

    A NULL text is empty. NULL doc_ids come first, repeated ones in the order of their texts; after the last comes the
    first. A table of one row is followed by itself. The text is shuffled once, to ordered ranges of doc_id; the first
    row of each range goes to the range before it as well.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    rows = runtime.docs_of(docs)
    bounds = runtime.order_bounds(rows, "doc_id", runtime.partitions(spark))
    n = max(1, len(bounds))
    bucket = runtime.bucket_of(F.col("doc_id"), bounds)
    no_id = rows.where(F.col("doc_id").isNull()).limit(1).count() > 0
    if no_id or not bounds:
        is_first = F.col("doc_id").isNull()
    else:
        is_first = F.col("doc_id") == bounds[0]
    opens = F.col("doc_id").isin(bounds[1:]) if len(bounds) > 1 else F.lit(False)
    # (range, whether it only follows): every row stands in its range; the first rows of a range follow the range before.
    own = F.struct(bucket.alias("at"), F.lit(0).alias("guest"))
    before = F.struct((bucket - 1).alias("at"), F.lit(1).alias("guest"))
    last = F.struct(F.lit(n - 1).alias("at"), F.lit(2).alias("guest"))
    places = F.filter(F.array(own, F.when(F.coalesce(opens, F.lit(False)), before), F.when(is_first, last)), lambda p: p.isNotNull())
    placed = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", F.col("p.at").alias("at"), F.col("p.guest").alias("guest"))
    ranged = placed.repartitionById(n, F.col("at")).sortWithinPartitions("guest", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter(bins, bits)
        held: tuple[int | None, str, np.ndarray, np.ndarray] | None = None
        closed = False

        def row(name: int | None, text: str, words: np.ndarray, values: np.ndarray, following: str, next_values: np.ndarray) -> tuple:
            new = edited(text, following)
            new_values = values if new == text else printer.values(shingle_hashes(printer.edited_words(text, words, following)))
            return (name, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), printer.packed(values), printer.packed(new_values), printer.likeness(values, new_values), printer.likeness(values, next_values))

        for batch in batches:
            out = []
            for name, text, guest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if guest and closed:
                    continue  # a later row that might have followed
                words = printer.words(text)
                values = printer.values(shingle_hashes(words))
                if held is not None:
                    out.append(row(*held, text, values))
                held = (name, text, words, values)
                if guest:
                    closed, held = True, None
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return ranged.mapInArrow(run, schema)
