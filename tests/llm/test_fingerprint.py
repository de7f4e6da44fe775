import hashlib
import random

import numpy as np
import pytest

from loomline.llm import fingerprint as fp
from loomline.llm.words import WordHashes, shingle_set, words_of

from tests.llm.conftest import ROWS


def expected(rows):
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        new = t[: len(t) - k] + following[:k]
        p = fp.Fingerprinter()
        a, b, c = p.of_text(t), p.of_text(new), p.of_text(following)
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), p.packed(a), p.packed(b), p.likeness(a, b), p.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "3", "9"])
def test_rows(spark, odd, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, fp.fingerprints(odd).collect()), key=str) == expected(ROWS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_ranges_and_one_row(spark):
    rows = [(i * 7 % 401, f"text number {i} of a few words and some more {i * i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        assert sorted(map(tuple, fp.fingerprints(df).collect()), key=str) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    one = df.limit(1)
    assert fp.fingerprints(one).first().near_next == 1.0


def test_empty(none):
    assert fp.fingerprints(none).count() == 0


@pytest.mark.parametrize("n", [1, 3, 30, 2000])
def test_likeness_is_near_the_true_one(n):
    draw, hashes, p = random.Random(n), WordHashes(), fp.Fingerprinter()
    errors = []
    for _ in range(20):
        words = [str(draw.random()) for _ in range(n + 4)]
        other = list(words)
        for _ in range(draw.randint(0, max(1, n // 40))):
            other[draw.randrange(len(other))] = "changed"
        a, b = " ".join(words), " ".join(other)
        x, y = (set(shingle_set(words_of(t), hashes).tolist()) for t in (a, b))
        errors.append(p.likeness(p.of_text(a), p.of_text(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.05 and np.max(np.abs(errors)) < (0.15 if n >= 30 else 0.35)


def test_reused_words():
    p, draw = fp.Fingerprinter(), random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("ab \n") for _ in range(draw.randint(0, 40))) for _ in range(2))
        assert np.array_equal(p.edited_words(a, p.words(a), b), p.words(fp.edited(a, b)))
