"""Lines of text files with their physical numbers, read in splits.

A file may be read by many tasks: lines are counted per split, the counts before a split give the number of its first
line, and a second pass over the same splits numbers its lines in their order. No task sees a whole file, unless its
compression can't be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import join_bounded, stored

_SPLIT = ["file_path", "file_block_start"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", *[F.col(f"_metadata.{c}").alias(c) for c in (*_SPLIT, "file_name")])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_path, original_file, record_position (from 1), line, for every physical line, blank ones too.

    Lines end at a line feed, a carriage return or both, as they do for Python's text files. The same whatever size the
    splits have; an empty file has no line.
    """
    lines = _lines(spark, path)
    counts = stored(lines.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*_SPLIT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys = list(zip(paths, starts, strict=True))
            first = np.array([True, *[a != b for a, b in zip(keys, keys[1:], strict=False)]])
            begins = np.flatnonzero(first)
            at = np.arange(len(keys)) - np.repeat(begins, np.diff(np.r_[begins, len(keys)]))
            run = len(keys) if len(begins) == 1 else int(begins[1])
            if keys[0] == last:  # the batch goes on in the split of the one before
                at[:run] += seen
            last, seen = keys[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["value", *_SPLIT, "file_name", "_at"])

    local = lines.mapInArrow(number, "value string, file_path string, file_block_start long, file_name string, _at long")
    placed = join_bounded(local, bases, _SPLIT, "left")
    position = F.coalesce(F.col("_base") + F.col("_at") + 1, F.raise_error(F.lit("the files were split differently in two passes")).cast("long"))
    return placed.select("file_path", F.col("file_name").alias("original_file"), position.alias("record_position"), F.col("value").alias("line"))


def parsed_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """file_path, original_file, record_position, line, is_blank, is_malformed and the fields in r, for every physical line."""
    lines = numbered_lines(spark, path)
    blank = F.trim(F.regexp_replace("line", r"[ \t\x0B\f\r ]+", " ")) == ""
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("is_blank", blank).withColumn("r", F.when(~F.col("is_blank"), parsed))
    bad = ~F.col("is_blank") & (F.col("r").isNull() | F.col("r._bad").isNotNull())
    return rows.withColumn("is_malformed", bad).withColumn("r", F.when(F.col("r").isNotNull(), F.col("r").dropFields("_bad")))


def line_counts(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Per file its physical lines, and how many of them are blank, malformed and records."""
    rows = parsed_lines(spark, path, schema)
    good = ~F.col("is_blank") & ~F.col("is_malformed")
    return rows.groupBy("file_path", "original_file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_blank").alias("blank"), F.count_if("is_malformed").alias("malformed"), F.count_if(good).alias("records"))
