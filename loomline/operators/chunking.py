"""Token windows over texts, and paragraphs packed into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import paragraphs_of

#: Rows that Python holds as objects at once, and rows of an Arrow batch of pages.
SLICE, BATCH = 128, 500


def window_starts(n: Column, budget: int, stride: int) -> Column:
    """Starts of windows of `budget` tokens, each `stride` after the one before, the last being the first that reaches the end."""
    count = F.when(n <= 0, 0).when(n <= budget, 1).otherwise(F.ceil((n - budget) / stride).cast("int") + 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def token_chunks(docs: DataFrame, key: str, tokens: str, most: int, overlap: int, special: int) -> DataFrame:
    """Overlapping windows of a token list: key, chunk_number (from 1), chunk_text, token_count (special ones included), first and last token."""
    budget = most - special
    if budget <= 0 or overlap >= budget:
        raise ValueError("the window must hold more than the special tokens and the overlap")
    starts = window_starts(F.size(tokens), budget, budget - overlap)
    out = docs.select(key, tokens, F.posexplode(starts).alias("i", "s")).withColumn("_w", F.slice(tokens, F.col("s") + 1, F.lit(budget)))
    return out.select(key, (F.col("i") + 1).alias("chunk_number"), F.array_join("_w", " ").alias("chunk_text"), (F.size("_w") + special).alias("token_count"), F.col("s").alias("chunk_start_token"), (F.col("s") + F.size("_w") - 1).alias("chunk_end_token"))


def packed_paragraphs(paragraphs: list[str], most: int, overlap: int, special: int, separator: int = 1) -> list[tuple[str, int, int, int]]:
    """Paragraphs joined while they fit; one that is too long alone is cut into windows. (text, token_count, first, last token)

    Positions count the separator between paragraphs.
    """
    out: list[tuple[str, int, int, int]] = []
    held: list[str] = []
    begin = end = at = 0

    def close() -> None:
        nonlocal held
        if held:
            out.append(("\n\n".join(held), end - begin + 1 + special, begin, end))
        held = []

    for paragraph in paragraphs:
        words = paragraph.split()
        if not words:
            continue
        last = at + len(words) - 1
        if len(words) + special > most:
            close()
            budget = most - special
            stride = budget - overlap
            for s in range(0, max(1, len(words) - budget + stride), stride):
                part = words[s : s + budget]
                out.append((" ".join(part), len(part) + special, at + s, at + s + len(part) - 1))
                if s + budget >= len(words):
                    break
        elif held and last - begin + 1 + special <= most:
            held.append(paragraph)
            end = last
        else:
            close()
            held, begin, end = [paragraph], at, last
        at = last + 1 + separator
    close()
    return out


_CHUNK_FIELDS = ["chunk_number", "chunk_text", "token_count", "chunk_start_token", "chunk_end_token"]
_CHUNK_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]


def _chunks(rows: DataFrame, key: str, lists: Callable[[pa.Array], list], most: int, overlap: int, special: int) -> DataFrame:
    """packed_paragraphs of what lists makes of the second column, in slices of Arrow batches; the first is the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(k, i + 1, *c) for k, p in zip(part.column(0).to_pylist(), lists(part.column(1)), strict=True) for i, c in enumerate(packed_paragraphs(p or [], most, overlap, special))]
            columns = zip(*rows, strict=True) if rows else [[] for _ in _CHUNK_TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNK_TYPES, strict=True)], [key, *_CHUNK_FIELDS])

    return rows.mapInArrow(run, f"{key} long, chunk_number int, chunk_text string, token_count int, chunk_start_token int, chunk_end_token int")


def paragraph_chunks(docs: DataFrame, key: str, paragraphs: str, most: int, overlap: int, special: int) -> DataFrame:
    """packed_paragraphs for every row."""
    return _chunks(docs.select(F.col(key).cast("long"), paragraphs), key, lambda lists: lists.to_pylist(), most, overlap, special)


def page_chunks(pages: DataFrame, key: str, html: str, most: int, overlap: int, special: int) -> DataFrame:
    """paragraph_chunks of page_paragraphs in one pass of small Arrow batches, so that a task has one Python worker, not two."""
    conf = pages.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return _chunks(pages.select(F.col(key).cast("long"), html), key, lambda texts: [paragraphs_of(h.as_py()) for h in texts], most, overlap, special)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """At most so many rows at a time, so that what Python holds does not grow with the rows of a batch."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def page_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and the paragraphs of each page, in slices of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([paragraphs_of(h) for h in part.column(1).to_pylist()], pa.list_(pa.string()))], [key, "paragraphs"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, paragraphs array<string>")
