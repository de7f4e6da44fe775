"""Vectors as arrays of float; sums in double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """The unit mean of unit vectors per group; dimensions are averaged apart, so no group meets in one task as arrays."""
    parts = vectors.select(group, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return means.select(group, unit(F.col("mean")).alias("centroid"))


def anchor_scores(vectors: DataFrame, key: str, vector: str, anchors: list[tuple[int, list[float]]]) -> DataFrame:
    """key, label, score: for each label the largest cosine to one of its anchors; one matrix product per Arrow batch.

    anchors: (label, unit vector), a catalogue of descriptors that fits on the driver.
    """
    labels = sorted({label for label, _ in anchors})
    matrix = np.array([v for _, v in anchors], float).T
    columns = [np.array([i for i, (label, _) in enumerate(anchors) if label == k]) for k in labels]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            sims = rows @ matrix
            best = np.stack([sims[:, c].max(1) for c in columns], axis=1)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, len(labels)), pa.int64()), pa.array(np.tile(labels, n), pa.int32()), pa.array(best.reshape(-1))], [key, "label", "score"])

    return vectors.select(F.col(key).cast("long"), vector).where(F.col(vector).isNotNull()).mapInArrow(score, f"{key} long, label int, score double")
