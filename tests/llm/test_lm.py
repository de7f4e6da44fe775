import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import lm

from tests.llm.conftest import ROWS


def words(text):
    return (text or "").encode().lower().split()


def brute(rows):
    """The contract's columns by their definition."""
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7
    counts = Counter()
    for d, t, *_ in rows:
        if fold(d) != 2:
            counts.update(words(t))
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t, *_ in rows:
        tokens = [*words(t), "end"]
        out.append((d, fold(d) == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 4)))
    return sorted(out, key=str)


def test_base_is_exact(odd, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)  # so that words are looked up by the join as well
    got = lm.lm_scores(odd).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == brute(ROWS)
    assert all(r.score < 0 and r.perplexity >= 1 for r in got)


def test_empty_and_untrained(spark, none):
    assert lm.lm_scores(none).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = lm.score(docs, lm.fit(docs.limit(0))).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and got.score <= 0


def test_probabilities_add_up(spark):
    text = "the cat sat on the mat and the dog sat on the log with a cat"
    docs = spark.createDataFrame([(i, text + f" extra{i}") for i in range(20)], "doc_id long, text string")
    model = lm.fit(docs)
    assert np.allclose((10**model.transitions).sum(1), 1)
    seen = {r.word: r.n for r in model.vocabulary.collect()}
    mass = np.zeros(lm.CLASSES + 1)
    for w, n in seen.items():
        item = model.head[bytes(w)] if model.head[bytes(w)] < lm.CORE else lm.CORE + lm.unit_of(bytes(w))
        g = model.group[item]
        mass[g] += (n - model.class_discount[g]) / model.class_tokens[g]
    used = mass > 0
    unseen = np.where(model.class_discount > 0, 10**model.class_unseen, 0)
    assert np.allclose((mass + unseen)[used], 1)


def test_score_equals_brute_force(spark, monkeypatch):
    """log10 of class transitions times word emissions, word by word, from the model's classes and the texts' own counts."""
    monkeypatch.setattr(lm, "HEAD", 25)
    monkeypatch.setattr(lm, "CORE", 1024)
    monkeypatch.setattr(lm, "LEARNED", 3)
    draw = np.random.default_rng(5)
    pool = [f"w{i}{'abc'[i % 3]}" for i in range(80)]
    rows = [(i, " ".join(draw.choice(pool, draw.integers(0, 40), p=np.arange(80, 0, -1) / 3240)) + f" rare{i} new{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id < 45")
    model = lm.fit(train)
    counts = Counter(w for i, t in rows if i < 45 for w in words(t))
    core = {w: i for w, i in model.head.items() if i < lm.CORE}
    learned = {int(h): int(c) for h, c in zip(model.hashes, model.learned, strict=True)}

    def class_of(w):
        if w in core:
            return int(model.group[core[w]])
        h = int(lm._hashes_of([w])[0])
        return learned.get(h, int(model.group[lm.CORE + lm.unit_of(w)]))

    tokens, types, after = Counter(), Counter(), Counter()
    for w, n in counts.items():
        tokens[class_of(w)] += n
        types[class_of(w)] += 1
    size, end = lm.CLASSES + 1, lm.CLASSES
    for i, t in rows:
        if i < 45:
            chain = [end, *map(class_of, words(t)), end]
            after.update(zip(chain, chain[1:], strict=False))
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    open_classes = {int(g) for g in model.group[lm.CORE : lm._END]}
    d = lambda c: (once / (once + 2 * twice) if once and twice else lm.DISCOUNT) if c in open_classes else 0.0
    rows_of, columns = Counter(), Counter()
    for (a, b), n in after.items():
        rows_of[a] += n
        columns[b] += n

    def step(a, b):
        low = (columns[b] + 1) / (sum(columns.values()) + size)
        free = sum(min(n, lm.DISCOUNT) for (x, _), n in after.items() if x == a)
        return (max(after[a, b] - lm.DISCOUNT, 0) + free * low) / rows_of[a] if rows_of[a] else low

    def emission(w):
        c = class_of(w)
        return (counts[w] - d(c)) / tokens[c] if counts[w] else (d(c) * types[c] / tokens[c] if tokens[c] and d(c) else 1.0)

    got = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    for i, t in rows:
        chain = [end, *map(class_of, words(t)), end]
        want = sum(math.log10(step(a, b)) for a, b in zip(chain, chain[1:], strict=False)) + sum(math.log10(emission(w)) for w in words(t))
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-6)


def test_exchange_raises_likelihood():
    draw = np.random.default_rng(2)
    kind = draw.integers(0, 3, 30)
    counts = np.where((kind[:, None] + 1) % 3 == kind[None, :], draw.integers(20, 60, (30, 30)), 0).astype(float)
    counts = np.pad(counts, (0, 1))
    group = lm.exchange(counts, 3)
    assert len({(a, b) for a, b in zip(kind, group[:-1], strict=True)}) == 3  # the hidden classes, whatever their names


def test_score_beats_base(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, " ".join([text] * 5)) for i in range(60)], "doc_id long, text string")
    assert lm.lm_scores(docs).where("held_out and score <= base_score").count() == 0


@pytest.mark.parametrize("word", [b"a", b"abcdef", "é".encode()])
def test_groups_agree_with_sql(spark, word):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(bytearray(word),)], "w binary").select((F.crc32(F.substring("w", -3, 3)) % lm.UNITS).alias("u")).first().u
    assert got == lm.unit_of(word)


def test_words_outside_the_core_get_classes_of_their_own(spark, monkeypatch):
    """Words of one ending in two kinds of places go to the classes of the frequent words there."""
    monkeypatch.setattr(lm, "HEAD", 30)  # the core is no larger, and classes of words outside the head count as well
    draw = np.random.default_rng(3)
    one, two = [f"a{i}xyz" for i in range(40)], [f"b{i}xyz" for i in range(40)]
    first, second = one + [f"c{i}" for i in range(10)] * 4, two + [f"d{i}" for i in range(10)] * 4
    rows = [(i, " ".join(f"p {draw.choice(first)} q r {draw.choice(second)} s" for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs)
    place = {int(h): int(c) for h, c in zip(model.hashes, model.learned, strict=True)}
    classes = [{place[h] for h in lm._hashes_of([w.encode() for w in ws]).tolist() if h in place} for ws in (one, two)]
    assert all(classes) and not classes[0] & classes[1]
    assert np.allclose((10**model.transitions).sum(1), 1) and model.class_tokens.sum() == sum(len(t.split()) for _, t in rows)
    assert lm.score(docs, model).where("score <= base_score").count() == 0
