"""Ranked candidates for merging: as with_support ranks them, with pairs packed on their only way through a shuffle."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import neighbours, support
from loomline.queries import QUERIES

SCHEMA = "g string, id long, v array<double>, narrative array<double>, terms array<long>, years array<long>, strict array<long>, same array<long>, docs array<double>, chunks array<double>, above array<long>, above_at array<double>"


def _topics(n=120):
    draw = np.random.default_rng(8)
    v = draw.normal(size=(n, 4))
    v[20:45] = v[20]  # copies
    v /= np.linalg.norm(v, axis=1)[:, None]
    some = lambda least, most: sorted(set(map(int, draw.integers(least, most, 5))))
    rows = []
    for i in range(n):
        told = v[(i + 1) % n].tolist() if i % 5 else None
        sets = [some(-3, 9), some(1990, 1997), some(0, 30), some(0, 4) if i % 7 else None]
        series = [[None if draw.random() < 0.3 else float(draw.integers(1, 6)) for _ in range(6)] for _ in range(2)]
        rows.append(("xyx"[i % 3] if i != 3 else None, 5 * i % 600 - 40, v[i].tolist(), told, *sets, *(series if i % 11 else [None, None]), [i // 2, 1000 + i // 4], [1.0, 2.5]))
    return rows


@pytest.mark.parametrize("packed,unpacked,strip", [(1 << 18, 1 << 20, 1 << 28), (40, 9, 900)])
def test_ranks_are_those_of_all_rows(spark, packed, unpacked, strip):
    topics = spark.createDataFrame(_topics(), SCHEMA)
    got = support.ranked_candidates(topics, ["g"], "id", "v", 2, 0.3, packed, unpacked, strip=strip, values=256)
    pairs = support.measured_candidates(topics, ["g"], "id", "v", 2, 0.3).withColumn("hierarchical_found", F.col("ancestor_distance").isNotNull())
    want = support.with_support(pairs, ["g"])
    assert sorted(got.columns) == sorted(want.columns)
    have = got.select(want.columns)
    assert have.schema.simpleString() == want.schema.simpleString()
    key = lambda r: (r.g, r.support_rank)
    have, want = (sorted(d.collect(), key=key) for d in (have, want))
    assert len(have) > 800 and have == want


@pytest.mark.parametrize("unpacked", [1, 3, 50])
def test_parts_of_a_cell_are_in_order(unpacked):
    draw = np.random.default_rng(1)
    words = draw.integers(0, 4, (len(support.WORDS), 400))
    words[2] = draw.permutation(400)
    words[1, ::9] = support.NONE
    blobs = [support.pa.py_buffer(support._pressed(support._planes(words[:, b : b + 70]))) for b in range(0, 400, 70)]
    parts = list(support._in_order(blobs, unpacked))
    assert len(parts) > 5 and (np.concatenate(parts, axis=1) == words[:, support._order(words)]).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_candidates_are_not_written(spark, monkeypatch):
    written = []
    for module in (support, neighbours):
        keep = module.stored
        monkeypatch.setattr(module, "stored", lambda df, keep=keep: written.append(df.columns) or keep(df))
    plan = QUERIES["merge_support"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert written and not [c for c in written if any("rank" in name for name in c)]
    assert "Window" not in plan
