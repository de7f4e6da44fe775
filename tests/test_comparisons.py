"""Orders, suffixes, matches and sentences of comparisons."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import numbers, sentences
from loomline.operators import comparisons


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x", "y"), (2, None, None, "y"), (3, "n", "x", "y")], "k int, name string, name_x string, name_y string")
    out = comparisons.coalesce_suffixes(df, "name").orderBy("k")
    assert out.columns == ["k", "name"] and [r.name for r in out.collect()] == ["x", "y", "n"]
    assert comparisons.coalesce_suffixes(out, "name") is out
    assert comparisons.preferred_columns(out, ["note", "name"]).columns == ["note", "name", "k"]
    assert comparisons.with_alias(out, "id", "k").columns == ["k", "name", "id"]
    assert comparisons.with_alias(out, "name", "k") is out
    catalogue = spark.createDataFrame([(1, "new")], "k int, name string")
    assert [tuple(r) for r in comparisons.refreshed(out, catalogue, "k").orderBy("k").collect()] == [(1, "new"), (2, None), (3, None)]


def test_panel_order(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 9), ("g", "c", 9), ("g", "z", 0)], "g string, k string, n int")
    out = comparisons.panel_order(df, ["g"], "k", ["z", "missing"], [F.desc("n"), F.col("k")]).orderBy("position")
    assert [r.k for r in out.collect()] == ["z", "b", "c", "a"]


def test_match_texts_and_rows(spark):
    docs = spark.createDataFrame([(5, "t", "x"), (3, "t", "x"), (1, "u", "x")], "doc_id int, topic string, text string")
    texts = spark.createDataFrame([("t", "x"), ("t", "gone")], "topic string, text string")
    assert {(r.text, r.doc_id) for r in comparisons.match_texts(texts, docs, ["topic"], "text", [F.col("doc_id")]).collect()} == {("x", 3), ("gone", None)}
    wide = spark.createDataFrame([(1, "a", None, "c"), (2, None, "", None)], "k int, v_1 string, v_2 string, v_3 string")
    assert [tuple(r) for r in comparisons.numbered_to_rows(wide, ["k"], "v", 3).orderBy("rank").collect()] == [(1, 1, "a"), (1, 3, "c")]


def test_span(spark):
    span = lambda *t: tuple(spark.range(1).select(comparisons.span([numbers.phase_years(F.lit(x).cast("string")) for x in t]).alias("s")).first().s)
    assert span("2005-2007", "from 2001 on", None, "none") == (2001, 2007)
    assert span(None, "") == (None, None)


@pytest.mark.parametrize("value", [0.0, 1.0, 0.5, 0.1234, 0.05678, 0.0499999, 0.00123, 0.000999, 0.00012, 0.0000456, 0.00001, 12.34])
def test_three_digits(spark, value):
    assert spark.range(1).select(sentences.significant3(F.lit(value))).first()[0] == f"{value:.3g}"


def test_peak_sentence(spark):
    def say(gap, r, q):
        return spark.range(1).select(sentences.peak_sentence(F.lit("C"), F.lit("E"), F.lit("media"), F.lit(gap).cast("int"), F.lit(r).cast("double"), F.lit(q).cast("double"))).first()[0]

    assert say(None, 0.5, 0.1).startswith('Peak timing could not be assessed for "C" and the media counterpart "E"')
    assert say(3, 0.5, 0.0123).startswith('For "C" and "E", the media counterpart peaks 3 years before') and "(rho=0.500, q=0.0123), so" in say(3, 0.5, 0.0123)
    assert "one year before the corporate anchor" in say(1, None, None) and say(1, None, None).endswith("is not available.")
    assert "slight corporate precedence" in say(-1, -0.25, None) and "(rho=-0.250, q=not available), so" in say(-1, -0.25, None)
    assert say(0, 0.0, 1.0).endswith("is zero (rho=0.000, q=1).") and "peaks 4 years before the media" in say(-4, 0.1, 0.5)


def test_dominant_pattern(spark):
    labels = [*sentences.LEADERS, sentences.UNCLEAR]

    def say(stable, **n):
        return spark.range(1).select(sentences.dominant_pattern({k: F.lit(n.get(k, 0)) for k in labels}, F.lit(stable))).first()[0]

    assert say(0) == "No robust temporal signal remains after post-comment filtering."
    assert say(0, synchronous_or_unclear=2) == "Mostly synchronous or inconclusive temporal ordering."
    assert say(1, synchronous_or_unclear=2, corporate_leads_media=1) == "Mostly synchronous/co-evolving, with isolated corporate-leading-media episodes (1 stable leading case)."
    assert say(0, synchronous_or_unclear=2, media_leads_corporate=1) == "Mostly synchronous/co-evolving, with isolated media-leading episodes."
    assert say(4, synchronous_or_unclear=2, media_leads_corporate=2, academic_leads_corporate=2) == "Academic discourse appears to lead corporate discourse, but with residual synchronous or unclear cases."
    assert say(2, corporate_leads_academic=2) == "Corporate discourse appears to lead academic discourse."


def test_document_cells_count_documents_of_all_levels(spark):
    """F8: three counts of distinct documents had a shuffle each, in as few tasks as the session has, whatever the rows."""
    from loomline.operators import series
    from loomline.storage import spread

    rows = [(s, b, y, d) for s, b, y, d in [("x", "p", 1, 7), ("x", "p", 1, 7), ("x", "q", 1, 7), ("x", "q", 2, 7), ("x", "q", 2, 8), ("y", "p", 1, 7), ("y", "p", 1, None), ("x", None, None, 9)]]
    df = spark.createDataFrame(rows, "source string, brand string, year long, document_id long")
    cells = series.document_cells(df, ["source", "brand"], ["source"])
    got = {(r.source, r.brand, r.year): (r.d, r.f) for r in cells.collect()}
    assert got == {("x", "p", 1): (1, 2), ("x", "q", 1): (1, 1), ("x", "q", 2): (2, 2), ("y", "p", 1): (1, 2), ("x", None, None): (1, 1)}
    sums = lambda keys, c: {tuple(r)[:-1]: r[-1] for r in cells.groupBy(*keys).agg(F.sum(c)).collect()}
    assert sums(["source", "year"], "d_year") == {("x", 1): 1, ("x", 2): 2, ("x", None): 1, ("y", 1): 1}
    assert sums(["source"], "d_total") == {("x",): 3, ("y",): 1}
    assert spread(df, "document_id", 1).rdd.getNumPartitions() == 8


def test_tables_of_the_app_share_their_chunks(spark, monkeypatch):
    """lines and parts were joined anew for every table, some of them several times."""
    from loomline.queries import app, comparisons, narratives, review

    made = []
    for module in (app, comparisons, narratives, review):
        own = module.chunks
        monkeypatch.setattr(module, "chunks", lambda *a, own=own: made.append(1) or own(*a))
    assert len(app.app_tables(spark, "/root/testdata/sf0.001")) == 7
    assert len(made) == 1


def test_series_of_pairs_are_made_of_counted_cells(spark):
    """chosen pairs and their series each joined lines and parts, and counted documents, several times."""
    from loomline.queries import series as queries

    plan = queries.pair_annual_series(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "p_brand" not in plan
