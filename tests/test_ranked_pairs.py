"""Pairs ranked in strips: against all pairs by brute force, over groups of several blocks, with ties and copies."""

from __future__ import annotations

import numpy as np
import pytest

from loomline.operators import neighbours, support


def _rows(n=90):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(n, 4))
    vectors[10:20] = vectors[10]  # copies
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return [("x" if i % 3 else "y", i, v.tolist()) for i, v in enumerate(vectors)]


def _want(rows, k, least, both_hold):
    out = {}
    for g in ("x", "y"):
        own = [(i, np.array(v)) for h, i, v in rows if h == g]
        for i, v in own:
            order = sorted((-float(neighbours.round6(np.array(v @ w))), j) for j, w in own if j != i)
            for rank, (value, j) in enumerate(order, 1):
                if (rank <= k and -value >= least) if both_hold else (rank <= k or -value >= least):
                    out.setdefault((g, min(i, j), max(i, j)), {})[i] = (rank, -value)
    return {key: (*[found.get(side, (None, 0))[0] for side in key[1:]], next(iter(found.values()))[1]) for key, found in out.items()}


@pytest.mark.parametrize("both_hold", [False, True])
@pytest.mark.parametrize("strip", [200, 1 << 24])
def test_ranks_of_either_side(spark, both_hold, strip):
    rows = _rows()
    df = spark.createDataFrame([*rows, (None, 500, [1.0, 0.0, 0.0, 0.0]), ("x", 501, None)], "g string, id long, v array<double>")
    got = neighbours.ranked_pairs(df, ["g"], "id", "v", 2, 0.6, both_hold, values=256, strip=strip)
    have = {(r.g, r.a, r.b): (r.rank_from_a, r.rank_from_b, r.similarity) for r in got.collect()}
    assert have == _want(rows, 2, 0.6, both_hold)


def test_measured_candidates_hold_what_is_missing_against_nothing(spark):
    schema = "g string, id long, v array<double>, narrative array<float>, terms array<long>, years array<long>, strict array<long>, same array<long>, docs array<double>, chunks array<double>, above array<long>, above_at array<double>"
    full = ([1.0, 0.0], [1, 2, 3], [1995], [7], [], [1.0, 2.0, None, 4.0, 5.0], [1.0, 2.0, 3.0, None, None], [9, 11], [1.0, 2.0])
    half = ([0.5, 0.5], [2, 3, 8], [], [7, 8], None, [2.0, 4.0, None, 8.0, None], [1.0, None, None, None, None], [10, 11], [1.0, 2.0])
    rows = [("x", 1, [1.0, 0.0], *full), ("x", 2, [1.0, 0.0], *half), ("x", 3, [1.0, 0.0], *[None] * 9)]
    got = {(r.a, r.b): r for r in support.measured_candidates(spark.createDataFrame(rows, schema), ["g"], "id", "v", 2, 0.2).collect()}
    r = got[1, 2]
    assert (r.narrative_similarity, r.term_count, r.year_count, r.strict_partner_count, r.same_issue_partner_count, r.ancestor_distance) == (0.5, 2, 0, 1, 0, 2.0)
    x, y = [1.0, 2.0, 4.0, 5.0], [2.0, 4.0, 8.0, 0.0]
    assert r.doc_correlation == round(float(np.corrcoef(x, y)[0, 1]), 6) and r.chunk_correlation is None
    none = got[1, 3]
    assert (none.narrative_similarity, none.term_count, none.doc_correlation, none.ancestor_distance) == (None, 0, None, None)


def test_support_ranks_over_cells(spark):
    rows = [("x", a, 100 + a, (a * 37 % 100) / 100 - 0.3, None, a % 3, 0, None, None, 0, 0, False) for a in range(60)]
    schema = "g string, a long, b long, similarity double, narrative_similarity double, term_count int, year_count int, doc_correlation double, chunk_correlation double, strict_partner_count int, same_issue_partner_count int, hierarchical_found boolean"
    got = support.with_support(spark.createDataFrame(rows, schema), ["g"]).collect()
    order = sorted(got, key=lambda r: (-r.support_signal_count, -r.similarity, r.a))
    assert [r.support_rank for r in order] == list(range(1, 61))
