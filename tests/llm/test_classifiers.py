import random

import numpy as np
import pytest

from loomline.llm import quality, toxicity
from loomline.llm.calibrate import Logistic


@pytest.fixture(scope="module")
def labelled(spark):
    """Bad texts repeat signs, toxic ones have one of two words with varied endings."""
    draw = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        words = ["".join(draw.choice("aeiou") + draw.choice("bdfgklmnprst") for _ in range(draw.randint(1, 3))) for _ in range(60)]
        toxic, good = i % 6 == 0, i % 4 != 1
        if toxic:
            for _ in range(3):
                words[draw.randrange(60)] = draw.choice(["grumblo", "zzfoulx"]) + draw.choice("abcdef") + draw.choice("abcdef")
        docs.append((i, " ".join(words) if good else "$$$ ".join(w.upper() for w in words) + "$$$"))
        labels.append((i, int(good), int(toxic)))
    labels += [(700, None, None), (None, 1, 1), (0, 0, 0)]  # the last contradicts another row
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels[:600]}


@pytest.mark.parametrize(("module", "column"), [(quality, 1), (toxicity, 2)])
def test_held_out_accuracy(labelled, module, column):
    docs, labels, truth = labelled
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == 600 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in held]) >= 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(labelled, odd, none, module):
    docs, labels, _ = labelled
    model = module.fit(docs, labels)
    got = module.score(odd, model).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[5] and len(by[9]) == 1  # NULL is empty; equal texts score alike
    assert module.score(none, model).count() == 0
    nothing = module.fit(docs, labels.limit(0))
    assert module.score(odd, nothing).where("score between 0 and 1").count() == odd.count()


def test_quality_has_the_rate_of_all_labels(spark):
    """86 of 100 are good; a sample of as many of either label must not move the scores, nor that of an empty text."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("aeiou") + draw.choice("bdfgklmnprst") for _ in range(draw.randint(1, 3)))
    docs, labels = [], []
    for i in range(1500):
        good = i % 100 < 86
        words = [word() for _ in range(12)]
        for _ in range(draw.randrange(3) if good else draw.randrange(1, 4)):
            words[draw.randrange(12)] = draw.choice(["$$$WIN$$$", "CLICK!!!"])  # both kinds have them, the bad ones more
        docs.append((i, " ".join(words)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*docs, (-1, ""), (-2, None)], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    for per_label in (50, 3000):
        rows = quality.score(docs, quality.fit(docs, table, per_label=per_label)).collect()
        scores = {r.doc_id: r.score for r in rows}
        assert abs(np.mean([v for k, v in scores.items() if k >= 0]) - 0.86) < 0.06
        assert scores[-1] == scores[-2] and abs(scores[-1] - 0.86) < 0.02


def test_filters_keep_columns(labelled, odd):
    docs, labels, truth = labelled
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {i for i in truth if not truth[i][2]} | {0}
    assert quality.keep_good(odd, quality.fit(docs, labels), 0.0).columns == odd.columns


def test_block_max_search_is_exact():
    draw = np.random.default_rng(3)
    rows = []
    for _ in range(500):
        terms = np.sort(draw.choice(40, draw.integers(1, 9), replace=False))
        weights = draw.random(len(terms))
        rows.append((terms, weights / np.linalg.norm(weights)))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(rows, 40)
    for i in range(0, 500, 7):
        near, sims = index.search(*rows[i], 10, without=i)
        want = dense @ dense[i]
        want[i] = 0
        assert np.allclose(sims, np.sort(want)[::-1][:10]) and np.allclose(want[near], sims)


def test_votes_equal_brute_force(labelled):
    """Cosines of every document with every example by their definition, over the documents' own frequencies."""
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    terms = {i: {t: n for t, n in toxicity.terms_of(t).items() if t in model.vocabulary} for i, t in texts.items()}
    df = {t: sum(t in c for c in terms.values()) for t in model.vocabulary}

    def unit(counts):
        w = {t: (1 + np.log(n)) * (np.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}

    vectors = {i: unit(c) for i, c in terms.items()}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert any(terms.values())
    for i, v in vectors.items():
        sims = sorted(((round(sum(w * vectors[j].get(t, 0) for t, w in v.items()), 12), -k) for k, j in enumerate(model.ids)), reverse=True)
        sims = [(s, model.ids[-k]) for s, k in sims if s > 0][: toxicity.NEIGHBOURS]
        pull = np.array([1 / (1.05 - min(s, 1)) for s, _ in sims])
        share = (pull @ np.array([truth[j][2] for _, j in sims], float) + model.rate) / (pull.sum() + 1) if sims else model.rate
        assert abs(got[i].score - float(model.calibration(toxicity._odds(np.array([share])))[0])) < 1e-6
        assert len([e for e in got[i].evidence.split("; ") if e]) == len(sims)


def test_ties_and_clashing_columns(spark, labelled):
    """Rows of equal similarity: the earlier example; columns of other names don't matter."""
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    twice = docs.unionByName(docs).selectExpr("*", "1 AS score", "2 AS label", "3 AS Toxic_Score")
    a, b = (sorted(map(tuple, toxicity.score(d, model).distinct().collect())) for d in (docs, twice))
    assert a == b and toxicity.score(twice, model).count() == 2 * docs.count()
    assert len(quality.score(twice, quality.fit(twice, labels.withColumn("text", labels.quality)), ).collect()) == 2 * docs.count()


def test_logistic_with_one_label():
    assert 0.9 < Logistic(np.zeros((20, 1)), np.ones(20)).base() < 1
    assert Logistic(np.empty((0, 1)), np.empty(0)).base() == pytest.approx(0.5)
