"""Token-id output (op1): whole texts as token ids in files of directly addressable codes, and back.

Documents go to ordered ranges of doc_id by one shuffle of their text, each range is tokenised and written as
segments of bounded size through Spark's own writer (several segments and their directory a file, on any file system
that Spark can write), and the files are read again as binary files. Places of first ids come from sums over segments, never over documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dac, runtime
from .tokenizer import encoder_of

END_ID = 2
#: Ids in a segment, beyond which a new one begins; a longer document has one of its own.
SEGMENT_IDS = 2_000_000
#: Segments in a file, which ends with a directory of where they begin; so many megabytes are read at once.
FILE_SEGMENTS = 16


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, joined: bool = True) -> None:
    """Writes the ids of every document, in ascending doc_id order, as segment files below path.

    A NULL text is empty: its ids are the end id alone. NULL doc_ids come first; rows that repeat a doc_id each have
    their own entry, in the order of their texts. An empty table gives no segment.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    rows = runtime.docs_of(docs)
    n = max(runtime.partitions(spark), rows.rdd.getNumPartitions())  # ranges grow with the input
    bounds = runtime.order_bounds(rows, "doc_id", n)
    ranged = rows.repartitionById(max(1, len(bounds)), runtime.bucket_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, joined)
        part, sequence = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        names: list[int | None] = []
        starts: list[int] = []
        count = 0

        sizes: list[int] = []

        def close(last: bool = False) -> Iterator[pa.RecordBatch]:
            payload = dac.encode(part, sequence, names, starts, np.frombuffer(b"".join(held), "<u4"))
            sizes.append(len(payload) + 1)
            yield pa.RecordBatch.from_pydict({"payload": pa.array([payload], pa.binary())})
            if last or len(sizes) == FILE_SEGMENTS:
                yield pa.RecordBatch.from_pydict({"payload": pa.array([dac.directory(sizes)], pa.binary())})
                sizes.clear()

        for batch in batches:
            ids_of = encoder.encode(batch.column(1).to_pylist())
            for name, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                if names and count + len(ids) // 4 + 1 > segment_ids:
                    yield from close()
                    sequence += 1
                    held, names, starts, count = [], [], [], 0
                names.append(name)
                starts.append(count)
                held += [ids, end]
                count += len(ids) // 4 + 1
        if names:
            yield from close(last=True)

    payloads = ranged.mapInArrow(segments, "payload binary")
    # The text writer puts a value's bytes as they are; the line end becomes one byte after the segment.
    payloads.select(F.col("payload").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS + 1).option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the segment files below path: doc_id, start, n_tokens, ids_crc32, and where it stands (part, segment, local_start)."""
    schema = "part long, segment long, doc_id long, local_start long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                for first in dac.places(data) if data.size else ():
                    segment = dac.Segment(memoryview(data)[first:], verify=True)
                    raw = memoryview(segment.all().astype("<u4").tobytes())
                    starts = segment.starts.tolist()
                    ends = [*starts[1:], segment.n_ids]
                    n = segment.n_docs
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([segment.part] * n, pa.int64()),
                            "segment": pa.array([segment.sequence] * n, pa.int64()),
                            "doc_id": pa.array(segment.doc_ids, pa.int64()),
                            "local_start": pa.array(starts, pa.int64()),
                            "n_tokens": pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        }
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = runtime.stored(files.mapInArrow(decode, schema), "token-rows")
    sums = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("ids"))
    # Two levels: over the parts, of which there are as many as tasks, then over the segments of each part.
    parts = sums.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_base"))
    inner = Window.partitionBy("part").orderBy("segment")
    bases = sums.join(parts, "part").select("part", "segment", (F.col("part_base") + F.sum("ids").over(inner) - F.col("ids")).alias("base"))
    return runtime.join_bounded(rows, bases, ["part", "segment"], "inner").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "segment", "local_start")


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Writes the files, reads them back, and returns a row per document."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    path = path or runtime.scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(spark, path)
