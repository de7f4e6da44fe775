"""Coherence, similar sets, merge support, text vectors and bundles."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import coherence, encoding, support, topics
from loomline.operators.relational import ContractError
from loomline.sources import bundle


@pytest.mark.parametrize("least", [0.01, 0.34, 0.5, 0.8, 1.0])
def test_similar_sets_equal_brute_force(spark, least):
    draw = random.Random(3)
    words = ["the"] * 30 + [f"w{i}" for i in range(25)]
    sets = [(draw.choice("xy"), i, [*{draw.choice(words) for _ in range(draw.randrange(9))}]) for i in range(90)]
    sets += [("x", 100 + i, sets[i][2]) for i in range(9)]
    got = {(r.g, r.a, r.b): (r.shared, round(r.jaccard, 9)) for r in coherence.similar_sets(spark.createDataFrame(sets, "g string, id int, s array<string>"), ["g"], "id", "s", least).collect()}
    want = {}
    for (g, a, s), (h, b, t) in combinations(sets, 2):
        both = set(s) & set(t)
        if g == h and both and len(both) / len(set(s) | set(t)) >= least:
            want[g, a, b] = (len(both), round(len(both) / len(set(s) | set(t)), 9))
    assert got == want


def brute_coherence(docs, terms):
    m = len([d for d in docs if d])
    df = lambda *ws: sum(all(w in d for w in ws) for d in docs)

    def npmi(a, b):
        n = df(a, b)
        if a == b:
            return 1.0
        if not n:
            return -1.0
        return 0.0 if n == m else math.log(n * m / (df(a) * df(b))) / -math.log(n / m)

    mean = [npmi(a, b) for a, b in combinations(terms, 2) if not df(a, b) == m]
    rows = np.array([[max(npmi(a, b), 0) for b in terms] for a in terms])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    middle = rows.mean(0) / np.linalg.norm(rows.mean(0))
    return sum(mean) / len(mean), float((rows @ middle).mean())


def test_coherence_equals_brute_force(spark):
    draw = random.Random(5)
    docs = [(i, draw.choice("gh"), " ".join(draw.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta"], weights=[9, 7, 3, 2, 1, 1], k=draw.randrange(7)))) for i in range(120)] + [(999, "g", None)]
    terms = [("g", "t1", w) for w in ("alpha", "beta", "gamma")] + [("g", "t2", w) for w in ("delta", "eps", "never")] + [("h", "t1", w) for w in ("alpha", "zeta")] + [("h", "lone", "beta")]
    tops = spark.createDataFrame(terms, "g string, topic string, term string")
    lists, counts = coherence.term_lists(spark.createDataFrame(docs, "id int, g string, text string"), ["g"], "id", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""), tops)
    got = {(r.g, r.topic): (r.coherence_npmi, r.coherence_cv) for r in coherence.coherence(coherence.pair_npmi(lists, counts, ["g"], tops), ["g"]).collect()}
    assert set(got) == {("g", "t1"), ("g", "t2"), ("h", "t1")}
    for (g, topic), values in got.items():
        own = sorted(t for a, b, t in terms if (a, b) == (g, topic))
        assert values == pytest.approx(brute_coherence([set((d or "").split()) for _, h, d in docs if h == g], own), abs=2e-6)


def test_flags(spark):
    sizes = spark.createDataFrame([("g", t, 10) for t in "abc"], "g string, topic string, topic_size long")
    scores = spark.createDataFrame([("g", "a", 0.1, 0.2), ("g", "b", 0.1, 0.9)], "g string, topic string, coherence_npmi double, coherence_cv double")
    overlaps = spark.createDataFrame([("g", "a", "b")], "g string, a string, b string")
    margins = spark.createDataFrame([("g", "b", 0.01, True), ("g", "c", 0.2, False)], "g string, topic string, nearest_centroid_margin double, has_near_centroid boolean")
    years = spark.createDataFrame([("g", "a", 2, 0.01), ("g", "b", 4, 0.05), ("g", "c", 9, 0.5)], "g string, topic string, active_year_count long, mean_consecutive_year_jaccard double")
    got = {r.topic: r.validation_flags for r in coherence.topic_quality(sizes, scores, overlaps, ["g"], margins, years).collect()}
    assert got == {"a": "high_top_word_overlap;low_cv_coherence;short_temporal_coverage", "b": "high_centroid_similarity;high_top_word_overlap;low_centroid_margin;low_temporal_word_stability;short_temporal_coverage", "c": ""}


def test_support_counts_what_is_there(spark):
    facts = "similarity double, narrative_similarity double, term_count int, year_count int, doc_correlation double, chunk_correlation double, strict_partner_count int, same_issue_partner_count int, hierarchical_found boolean"
    rows = spark.createDataFrame([("g", 1, 2, 0.65, 0.60, 2, 4, 0.3, 0.3, 1, 1, True), ("g", 1, 3, 0.64, None, 1, 3, None, -1.0, 0, 0, None), ("g", 2, 3, 0.9, None, 5, 9, None, None, 0, 2, False)], f"g string, a int, b int, {facts}")
    got = {(r.a, r.b): (r.support_signal_count, r.support_rank) for r in support.with_support(rows, ["g"]).collect()}
    assert got == {(1, 2): (9, 1), (1, 3): (0, 3), (2, 3): (4, 2)}


def test_series_correlation_over_years_of_either(spark):
    series = spark.createDataFrame([("g", 1, y, float(y % 4)) for y in range(6)] + [("g", 2, y, float(y % 4) * 2) for y in range(1, 8)] + [("g", 3, 1, 1.0)], "g string, id int, year int, doc double")
    pairs = spark.createDataFrame([("g", 1, 2), ("g", 1, 3), ("g", 3, 4)], "g string, a int, b int")
    got = {(r.a, r.b): r.doc_correlation for r in support.series_correlation(pairs, series, ["g"], "id", ["doc"]).collect()}
    x = [float(y % 4) if y < 6 else 0.0 for y in range(8)]
    y = [float(y % 4) * 2 if y else 0.0 for y in range(8)]
    z = [1.0 if y == 1 else 0.0 for y in range(6)]
    assert got[1, 2] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6) and got[1, 3] == pytest.approx(np.corrcoef(x[:6], z)[0, 1], abs=1e-6) and got[3, 4] is None


def test_vectors_do_not_depend_on_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 3 else f"Some words {'more ' * (i % 7)} of text{chr(97 + i % 26) * 3} {i}") for i in range(60)], "id int, t string")
    log = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return encoding.HashingEncoder(8)

    runs = [{r.id: r.vector for r in encoding.encode_texts(rows.repartition(n), "id", "t", f"m-{log}", load, 8, batch).collect()} for n, batch in ((1, 4), (3, 32), (7, 1))]
    assert runs[0] == runs[1] == runs[2] and runs[0][3] == [0.0] * 8
    assert all(sum(x * x for x in v) == pytest.approx(1) for k, v in runs[0].items() if k != 3)
    started = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(started) == len(set(started))  # once a process

    def wrong(texts):
        return np.zeros((len(texts), 3))

    with pytest.raises(Exception, match="shape"):
        encoding.in_buckets(["a"], wrong, 8, 2)


def test_bundle_is_whole_or_absent(spark, tmp_path):
    root = str(tmp_path)
    topics, series = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), spark.createDataFrame([("a", 2000), (None, 2001)], "topic string, year int")
    own = [bundle.Reference("series", "topic", "topics", "id")]
    token = bundle.write_bundle(spark, root, {"topics": topics, "series": series}, {"topics": ["id"]}, own, {"public": True})
    tables, missing = bundle.load_bundle(spark, root, token, ["topics", "series"], {"extra": "x int"})
    assert not missing and tables["series"].count() == 2 and tables["extra"].count() == 0
    assert bundle.load_bundle(spark, root, token, ["topics"])[0]["topics"] is tables["topics"]
    assert bundle.load_bundle(spark, root, token, ["topics", "panels"]) == ({}, ["panels"])
    assert bundle.read_manifest(spark, root, token)["row_counts"] == {"topics": 2, "series": 2}
    with pytest.raises(ContractError, match="1 values that are not in topics.id"):
        bundle.write_bundle(spark, root, {"topics": topics.where("id = 'b'"), "series": series}, {}, own)
    with pytest.raises(ContractError, match="several rows"):
        bundle.write_bundle(spark, root, {"topics": topics.union(topics), "series": series}, {"topics": ["id"]}, own)
    unfinished = [p.name for p in tmp_path.iterdir() if p.name != token]
    assert len(unfinished) == 2 and all(bundle.load_bundle(spark, root, t, ["topics"]) == ({}, ["manifest"]) for t in unfinished)
    topics.write.mode("append").parquet(f"{root}/{token}/topics")
    bundle._loaded.clear()
    with pytest.raises(ContractError, match="4 rows, not 2"):
        bundle.load_bundle(spark, root, token, ["topics"])


def test_silhouette_equals_brute_force(spark):
    from loomline.operators.serving import silhouette

    draw = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 12), ("b", 9), ("c", 1)):
        center = draw.normal(size=6)
        for _ in range(n):
            v = center + draw.normal(size=6) / 2
            rows.append((len(rows), g, (v / np.linalg.norm(v)).tolist()))
    got = {r.g: (r.sampled, r.silhouette) for r in silhouette(spark.createDataFrame(rows, "id int, g string, v array<double>"), "id", "g", "v", 100).collect()}
    m, names = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    far = 1 - m @ m.T
    for g in "ab":
        values = []
        for i in np.flatnonzero(names == g):
            own = far[i][(names == g) & (np.arange(len(rows)) != i)].mean()
            other = min(far[i][names == h].mean() for h in "abc" if h != g)
            values.append((other - own) / max(own, other))
        assert got[g] == (int((names == g).sum()), pytest.approx(np.mean(values), abs=1e-6))
    assert got["c"] == (1, None)


def test_records_of_answers(spark):
    from loomline.functions import payloads

    rows = spark.createDataFrame([(1, '{"micro_topic_id": "7.9", "source": "x", "summary": ["a", "b"], "topic_name_original": "3_own_name"}', "sub", 5), (2, "bad", None, 5), (3, '{"micro_topic_id": true, "title": "T"}', "sub", None)], "i int, a string, s string, n int")
    given = {"subgroup": F.col("s"), "source": F.lit("media"), "micro_topic_id": F.col("n"), "overall_summary": F.lit("none"), "evidence_note": F.lit("given"), "default_year_span": F.lit("2001-2003")}
    got = {r.i: r.f for r in rows.select("i", payloads.canonical_record(F.col("a"), given).alias("f")).collect()}
    assert (got[1].micro_topic_id, got[1].source, got[1].subgroup, got[1].topic_label_refined, got[1].overall_summary) == (7, "media", "sub", "Own Name", "['a', 'b']")
    assert (got[2].micro_topic_id, got[2].subgroup, got[2].overall_summary, got[2].evidence_note) == (5, "", "", "given")
    assert (got[3].micro_topic_id, got[3].topic_label_refined) == (0, "T") and got[1].phase_1_years == "2001-2003"


def test_review_buckets_and_merged_groups(spark):
    from loomline.operators import merged

    included = spark.createDataFrame([(1, "media", 9, 0.9, 2, True, "direct_pair_above_threshold"), (2, "media", 9, 0.1, 0, False, "below_threshold"), (3, "academic", None, None, 0, False, "no_pair")], "id int, source string, best_counterpart int, best_similarity double, qualifying_pairs long, is_included boolean, inclusion_reason string")
    anchors = spark.createDataFrame([(9, "corporate"), (8, "corporate")], "id int, source string")
    got = {r.id: (r.bucket, r.best_counterpart, r.inclusion_reason) for r in merged.hybrid_review(included, anchors, "id").collect()}
    assert got == {1: ("linked", 9, "direct_pair_above_threshold"), 2: ("backlog", 9, "below_threshold"), 3: ("backlog", None, "no_pair"), 8: ("unlinked_anchor", None, "no_external_counterpart")}
    members = spark.createDataFrame([("s", "G", "b", "L", " x ", True, 3, [2001], ["t", "u"], ["c1"]), ("s", "G", "a", "M", "", False, 5, [1999, 2001], ["v", "t"], ["c2", "c1"]), ("s", "S", "z", "", None, True, 8, [], [], [])], "s string, g string, m string, label string, summary string, is_ready boolean, topic_size long, years array<int>, terms array<string>, chunks array<string>")
    rows = {r.g: r for r in merged.group_metadata(members, ["s"], "g", "m").collect()}
    g, s = rows["G"], rows["S"]
    assert (g.group_size, g.topic_size, g.overall_keywords, g.representative_chunks_json, g.years_present_json, g.heterogeneity_note) == (2, 8, '["v","t","u"]', '["c2","c1"]', "[1999,2001]", merged.NOTES[1])
    assert (g.cumulative_share, s.cumulative_share, s.active_year_min, s.heterogeneity_note) == (0.5, 1.0, None, merged.NOTES[0])


def test_texts_are_cut_once_for_the_terms_of_topics(spark):
    """counts of terms were made anew, from the texts, for totals, means and scores."""
    words = spark.createDataFrame([("x", "a b b"), ("y", "b c"), ("y", "c")], "t string, text string").select("t", F.explode(F.split("text", " ")).alias("term"))
    out = topics.class_terms(words, "t", "term", 1)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.t, r.term, r.n) for r in out.collect()} == {("x", "a", 1), ("y", "c", 2)}


def test_pairs_of_documents_with_the_same_terms(spark):
    """the pairs are made once for each list of terms, and counted for every document that has it."""
    lists = spark.createDataFrame([("g", d, t) for d in range(50) for t in (("p", "q") if d % 2 else ("p", "q", "r"))], "lang string, doc int, term string")
    tops = spark.createDataFrame([("g", "z", t) for t in "pqr"], "lang string, topic string, term string")
    sizes = spark.createDataFrame([("g", 50)], "lang string, m long")
    got = coherence.pair_npmi(lists, sizes, ["lang"], tops)
    assert got.schema["pair_documents"].dataType.simpleString() == "bigint"
    assert {(r.term_a, r.term_b): r.pair_documents for r in got.collect()} == {("p", "q"): 50, ("p", "r"): 25, ("q", "r"): 25}
