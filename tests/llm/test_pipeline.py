"""The pipeline on a small corpus against brute force, and the registered queries."""

import os
import random

import pytest

import corpus_pipeline
from loomline.llm.queries import ORACLE_SQL, QUERIES

from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_neardup import brute as components


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("aeiou") + draw.choice("bdfgklmnprst") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(15))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(80)]
        toxic, good = i % 9 == 0, i % 5 != 2
        if toxic:
            words[5:8] = ["zzfoula", "zzfoulb", "zzfoulc"]
        if i % 11 == 3:
            words[20:35] = draw.choice(items)[1].split()
        text = " ".join(words) if good else "$$$ ".join(w.upper() for w in words) + "$$$"
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(400 + k, *docs[4 + 9 * k][1:]) for k in range(5)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, labels, items


def test_stages(spark, data):
    root, docs, labels, items = data
    truth = {i: (q, t) for i, q, t in labels} | {400 + k: labels[4 + 9 * k][1:] for k in range(5)}
    left = [(d[0], d[1]) for d in docs if truth[d[0]] == (1, 0)]
    kept = {r[0] for r in components(left) if r[3]}
    left = [d for d in left if d[0] in kept]
    clean = {r[0] for r in contaminated(left, items) if not r[5]}
    got = {r.doc_id for r in corpus_pipeline.run(spark, root).select("doc_id").distinct().collect()}
    assert got == {d for d, _ in left if d in clean}


def test_near_copies_from_eighty_per_cent(spark):
    """Pairs from 0.80 up to 0.85 are near copies to the stage, those just below are not."""
    def pair(i, fresh):
        words = [f"w{i}x{k}" for k in range(104)]
        return [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:104 - fresh] + [f"v{i}x{k}" for k in range(fresh)]))]

    rows = [r for i in range(30) for r in pair(i, 9 + i % 3)]  # Jaccard 91/109, 90/110, 89/111
    rows += [r for i in range(30, 40) for r in pair(i, 12)]  # 88/112
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {d for d, _ in rows if d % 2 == 0 or d >= 60}


def test_shape(spark, data):
    root = data[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), root).columns == docs.columns


def test_stages_on_odd_rows(spark, data, odd, none, tmp_path):
    """NULLs, empty, very long and repeated rows and clashing names; each stage takes rows out, none adds or alters any."""
    root = data[0]
    before = {repr(r) for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, root)
        assert kept.columns == odd.columns and {repr(r) for r in kept.collect()} <= before, name
        assert stage(spark, none, root).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, root).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    import duckdb

    root, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{root}/{t}.parquet'")
    got, want = QUERIES[name](spark, root).toPandas(), con.sql(ORACLE_SQL[name]).df()
    order = lambda d: d[sorted(d)].sort_values("doc_id").reset_index(drop=True)
    assert order(got).equals(order(want))
