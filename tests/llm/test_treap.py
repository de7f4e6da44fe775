import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomline.llm import treap
from loomline.llm.queries import ORACLE_SQL, op13_ranked_search

from tests.llm.conftest import ROWS
from tests.test_queries import rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    """Every document's score for every item, from the contract alone."""
    terms = [TERM.findall((text or "").translate(LOWER)) for _, text in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    out = []
    for name, text in items:
        scored = []
        for (doc_id, _), ts in zip(docs, terms, strict=True):
            tf, score = Counter(ts), 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if tf[t]:
                    m = 75 + 25 * len(ts) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort()
        out += [(name, i, s[3], -s[0]) for i, s in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [(i if i % 17 else None, " ".join(draw.choices(words, k=draw.choice([0, 3, 20, 200])))) for i in range(n)]
    docs += [(1000 + i, docs[7][1] + " zz") for i in range(60)] + [(5, docs[5][1])]  # many equal scores, a repeated row
    draw.shuffle(docs)
    items = [(f"i{j}", " ".join(draw.choices(words, k=draw.choice([1, 5, 40])))) for j in range(12)]
    return docs, [*items, ("copy", docs[3][1]), ("copy", docs[4][1]), (None, "zz ZZ"), ("none", None), ("strange", "qqqqq !!")]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed, 300)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = treap.ranked_search(table, spark.createDataFrame(items, "item_id string, text string"), 7)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, items, 7)


def test_small_shards_and_blocks(spark, monkeypatch):
    """The result doesn't depend on how documents are dealt into shards, nor items into blocks and groups."""
    docs, items = corpus(9, 120)
    monkeypatch.setattr(treap, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(treap, "HELD_NODES", 50)
    monkeypatch.setattr(treap, "TASK_SHARDS", 2)
    build = treap.build_index
    monkeypatch.setattr(treap, "build_index", lambda d, v: build(d, v, 10, 150))
    got = treap.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), 5)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, items, 5)


def test_trees_are_in_heap_and_search_order():
    draw = random.Random(1)
    order = np.array([draw.randrange(50) for _ in range(500)])
    starts = np.array([0, 1, 200])
    left, right, roots = treap.heap_tree(order, starts)
    for begin, end, root in zip(starts, [1, 200, 500], roots, strict=True):
        seen = []

        def walk(node):
            for child in (left[node], right[node]):
                assert child == -1 or order[child] <= order[node]
            if left[node] >= 0:
                walk(left[node])
            seen.append(node)
            if right[node] >= 0:
                walk(right[node])

        walk(root)
        assert seen == list(range(begin, end)) and order[root] == order[begin:end].max()


def test_pruning_skips_most_documents(spark, monkeypatch):
    """A rare pair of words: few ranges are split, whatever the common words."""
    docs = [(i, f"common words here {'rare ' * (i % 500 == 0)} x{i}") for i in range(4000)]
    split = []
    add = treap.Best.add
    monkeypatch.setattr(treap.Best, "add", lambda self, item, *rest: (split.append(len(item)), add(self, item, *rest))[1])
    vocabulary = {b"common": 0, b"rare": 1}
    index = treap.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), vocabulary)
    table = [tuple(r)[1:] for r in index.shards.collect()]
    best = treap.Best(1, 3)
    treap.search_shard(treap.Shard(table), [(0, np.array([0, 1]), index.weights)], best)
    assert best.ids[0].tolist() == [0, 500, 1000] and sum(split) < 400


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "alpha beta word3", "x"), (1, None, "x"), (2, "école 字 two", "x")], "item_id int, text string, rank string")
    got = treap.ranked_search(odd, items)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in ROWS], [(1, "alpha beta word3"), (1, None), (2, "école 字 two")], 20)
    assert treap.ranked_search(none, items).count() == 0 and treap.ranked_search(odd, items.limit(0)).count() == 0


def test_equals_sql(spark, tmp_path):
    docs, items = corpus(4, 200)
    docs = [(d, t) for d, t in dict(docs).items() if d is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, t) for n, (_, t) in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(op13_ranked_search(spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLE_SQL["op13_ranked_search"]).df())
