import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.llm import decontam

from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for d, t, *_ in docs:
        ws, hit, found = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(10, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                for s in range(len(ws) - n + 1):
                    if ws[s : s + n] == iw[k : k + n]:
                        hit.update(range(s, s + n))
                        if item is not None:
                            found.add(str(item))
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(docs, items):
    return sorted(map(tuple, decontam.contamination(docs, items).collect()), key=str)


ITEMS = [(1, "beta gamma"), (2, "Of more than five words"), (2, "two words"), (3, None), (4, "--"), (None, "école"), (5, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (6, "theta")]


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("pos", F.lit(1))
    assert run(odd, items) == brute(ROWS, ITEMS)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_random(spark, monkeypatch, limit):
    """By broadcast and, with heavy keys, by shuffle: a third of all words is the same one."""
    monkeypatch.setattr(decontam, "BROADCAST_TERMS", limit)
    monkeypatch.setattr("loomline.llm.runtime.HEAVY_SHARE", 10)
    draw = random.Random(8)
    some = lambda n: " ".join(draw.choice("aabcdeA") for _ in range(n))
    items = [(i, some(draw.choice([0, 1, 3, 9, 10, 11, 20]))) for i in range(25)]
    docs = [(i, some(draw.randint(0, 60)) + draw.choice(["", " ", "! "]) + draw.choice(items)[1].upper()) for i in range(60)]
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(none, items) == []
    assert run(odd, items.limit(0)) == brute(ROWS, [])


@pytest.mark.parametrize("limit", [0, 500_000])
def test_both_ways_to_meet_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_TERMS", limit)
    docs, items = [(1, "a b c d"), (2, "b c"), (3, None), (None, "B İ c i̇")], [(7, "b c"), (8, "i̇"), (9, "İ")]
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x red y green blue"), (2, "red green blue"), (3, "red x x x x green blue")], "doc_id long, text string")
    phrases, _ = decontam.windows_of(spark.createDataFrame([(1, "red green blue")], "item_id long, text string"))
    index = decontam.build_index(docs, phrases.select(F.explode("words").alias("word")).distinct())
    ids = {r.row: r.doc_id for r in index.sizes().collect()}
    assert {ids[r.row] for r in decontam.phrase_matches(index, phrases).collect()} == {2}
    assert {ids[r.row] for r in decontam.proximity_matches(index, phrases, 1).collect()} == {1, 2}


def test_drop(spark, odd):
    items = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 5, 8, 12, 13], key=str)


def test_drop_goes_by_row(spark):
    """A NULL or repeated doc_id doesn't take other texts with it."""
    rows = [(None, "x red green y"), (None, "clean"), (4, "red green"), (4, "clean too"), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS pos", "3 AS term")
    items = spark.createDataFrame([(1, "red green")], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for r in rows if "red" not in (r[1] or "")], key=str)
