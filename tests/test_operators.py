import pytest
from pyspark.sql import functions as F

from loomline.operators import chunking, graph, matching, relational, sampling, series


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_series_with_gaps_and_zero_denominators(spark):
    data = [("a", y, n, d) for y, n, d in [(2000, 2, 4), (2001, 0, 4), (2003, 4, 8), (2004, 3, 0)]]
    df = spark.createDataFrame(data, "k string, year long, document_count long, annual_source_macro_document_count long")
    full = series.dense(df, ["k"], ["document_count", "annual_source_macro_document_count"])
    assert full.count() == 5
    df = full.withColumn("annual_document_prevalence", F.coalesce(F.try_divide("document_count", "annual_source_macro_document_count"), F.lit(0.0)))
    facts = series.series_stats(df, ["k"]).first()
    assert (facts.first_active_year, facts.peak_year, facts.active_year_count, facts.total_document_count) == (2000, 2003, 3, 9)  # equal shares: the larger count
    value = df.select(series.correlation_value().alias("v"), "year")
    assert value.where("year = 2004").first().v is None
    index = {r.year: r.index_value for r in series.indexed(df, ["k"], "annual_document_prevalence").collect()}
    assert index[2000] == 100 and index[2001] == 0


def test_lag_one(spark):
    x = [1, 5, 2, 8, 3, 9, 4]
    left = spark.createDataFrame([("k", 2000 + i, float(v)) for i, v in enumerate(x)], "k string, year long, x double")
    right = spark.createDataFrame([("k", 2001 + i, float(v)) for i, v in enumerate(x)], "k string, year long, y double")
    corr = series.lag_correlation(series.lagged(left, right, ["k"], [-1, 0, 1]), ["k"], 4)
    best = series.best_lag(corr, ["k"], "correlation", nearest_zero=True).first()
    assert (best.best_lag, round(best.best_correlation, 6)) == (1, 1.0)
    few = series.lag_correlation(series.lagged(left.limit(3), right, ["k"], [0]), ["k"], 4).first()
    assert few.correlation is None


def test_lag_ties(spark):
    corr = spark.createDataFrame([("k", lag, 5, r) for lag, r in [(-1, 0.5), (1, -0.5), (0, 0.1)]], "k string, lag int, n_overlap_years long, correlation double")
    assert series.best_lag(corr, ["k"], "correlation", nearest_zero=False).first().best_lag == -1
    assert series.best_lag(corr, ["k"], "correlation", nearest_zero=True).first().best_lag == 1


def test_constant_series_has_no_correlation(spark):
    pairs = spark.createDataFrame([("k", 0, float(i), 1.0) for i in range(6)], "k string, lag int, x double, y double")
    assert series.lag_correlation(pairs, ["k"], 4).first().correlation is None
    assert series.rank_correlation(pairs, ["k"], 4).first().spearman_r is None


def test_until_share(spark):
    df = spark.createDataFrame([("g", "a", 50), ("g", "b", 25), ("g", "c", 15), ("g", "d", 10), ("z", "a", 0), ("z", "b", 0)], "g string, t string, n long")
    assert rows(relational.until_share(df, ["g"], "n", 0.75, 1, 10, "t").select("g", "t"), "g", "t") == [("g", "a"), ("g", "b"), ("z", "a")]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7)], "a long, b long")
    assert rows(graph.components(edges), "node") == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert graph.components(chain).select("root").distinct().count() == 1
    assert graph.components(edges.limit(0)).count() == 0


def test_review_groups(spark):
    members = spark.createDataFrame([("s", i) for i in (1, 2, 3, 4)] + [("t", 1), ("t", 2)], "g string, n long")
    edges = spark.createDataFrame([("s", 2, 3), ("t", 1, 2)], "g string, a long, b long")
    out = rows(graph.review_groups(members, edges, "g", "n").select("g", "n", "proposed_group_id", "is_singleton"), "g", "n")
    assert out == [("s", 1, None, True), ("s", 2, "PG01", False), ("s", 3, "PG01", False), ("s", 4, None, True), ("t", 1, "PG01", False), ("t", 2, "PG01", False)]


def test_trees(spark):
    tree = spark.createDataFrame([("g", 10, 1, 2, 0.1), ("g", 11, 10, 3, 0.4), ("g", 12, 11, 4, 0.9)], "g string, parent long, left long, right long, distance double")
    below = graph.leaves(tree)
    assert rows(below.where("parent = 11").select("leaf"), "leaf") == [(1,), (2,), (3,)]
    pairs = spark.createDataFrame([(1, 3), (1, 4), (1, 9)], "a long, b long")
    assert rows(graph.closest_ancestor(pairs, below).select("a", "b", "ancestor"), "b") == [(1, 3, 11), (1, 4, 12), (1, 9, None)]
    assert rows(graph.branchlets(tree, below, "g").select("node", "root"), "node") == [(1, 1), (2, 1)]


def test_mutual_nearest_with_a_tie(spark):
    left = spark.createDataFrame([("m", 1, [1.0, 0.0]), ("m", 2, [0.0, 1.0])], "m string, id long, v array<float>")
    right = spark.createDataFrame([("m", 7, [1.0, 0.0]), ("m", 8, [1.0, 0.0]), ("m", 9, [0.0, 1.0])], "m string, id long, v array<float>")
    got = matching.cross_pairs(left, right, ["m"], "id", "v").where("is_mutual_nearest")
    assert rows(got.select("id_a", "id_b"), "id_a") == [(1, 7), (2, 9)]


def test_filter_then_rank_is_not_rank_or_threshold(spark):
    pairs = spark.createDataFrame([("g", 1, 2, 0.9), ("g", 1, 3, 0.8), ("g", 2, 3, 0.1)], "g string, a long, b long, similarity double")
    first = matching.merge_candidates(pairs, ["g"], 1, 0.5, rank_first=False)
    assert rows(first.select("a", "b", "selected_from_both_directions"), "a", "b") == [(1, 2, True), (1, 3, False)]
    either = matching.merge_candidates(pairs, ["g"], 1, 0.05, rank_first=True)
    assert either.count() == 3


def test_chunker_edges():
    pack = chunking.packed_paragraphs
    assert pack([], 10, 2, 2) == [] and pack(["  "], 10, 2, 2) == []
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    assert [c[1:] for c in pack([words(3), words(4), words(2)], 10, 2, 2)] == [(10, 0, 7), (4, 9, 10)]
    assert [c[1:] for c in pack([words(2), words(20), words(2)], 10, 2, 2)] == [(4, 0, 1), (10, 3, 10), (10, 9, 16), (10, 15, 22), (4, 24, 25)]


@pytest.mark.parametrize(("n", "want"), [(0, []), (8, [0]), (9, [0, 6]), (14, [0, 6]), (15, [0, 6, 12])])
def test_window_starts(spark, n, want):
    assert spark.range(1).select(chunking.window_starts(F.lit(n), 8, 6)).first()[0] == want


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    for broken in (lambda: relational.require_unique(df, ["k"]), lambda: relational.require_columns(df, ["x"]), lambda: relational.join_one(df, df, ["k"]), lambda: relational.first_present(df, ["x"])):
        with pytest.raises(relational.ContractError):
            broken()
    with pytest.raises(relational.ContractError):
        relational.attach_sides(spark.createDataFrame([(1, 9)], "k_a long, k_b long"), df.limit(1), "k", ["v"])


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "a") for i in range(60)], "id long, g string")
    for draw in (lambda d: sampling.proportional(d, "g", "id", 17, 1), lambda d: sampling.round_robin(d, "g", "id", 17, 1)):
        a, b = draw(df), draw(df.repartition(7))
        assert a.count() == 17 and {r.id for r in a.collect()} == {r.id for r in b.collect()}
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "g string, n long")
    assert rows(sampling.quotas(counts, "g", "n", 4), "g") == [("a", 2), ("b", 1), ("c", 1)]


def test_filing_identifiers_of_all_orders(spark, tmp_path):
    from loomline.queries import QUERIES

    rows = spark.createDataFrame([(k, 7, "1997-03-05") for k in (5, 99_999, 100_000, 1_234_567, 60_000_003)], "o_orderkey long, o_custkey long, d string")
    rows.selectExpr("o_orderkey", "o_custkey", "CAST(d AS date) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.accession, r.item, r.filing_date) for r in QUERIES["filing_identifiers"](spark, str(tmp_path)).collect()}
    # One in five is malformed: no part of it is read. The others have item 1 + key % 9.
    want = {k: (None, None, "") if k % 5 == 0 else (f"0000000007-97-{k % 10**6:06d}", f"{1 + k % 9}A", "1997-03-05") for k in (5, 99_999, 100_000, 1_234_567, 60_000_003)}
    assert got == want and sum(v[0] is None for v in got.values()) == 2
