import duckdb
import pytest

from loomline.llm import audit
from loomline.llm.queries import ORACLE_SQL, op11_filter_audit

from tests.test_queries import rows


def docs_of(spark):
    fine = " ".join(f"word{i}" for i in range(250))
    data = [
        (1, fine, "en"), (2, fine, "de"), (2, fine, "en"), (3, fine.upper(), None), (4, None, "en"), (5, "", ""), (None, "", "en"), (None, fine, "de"),
        (6, "a b " * 200, "en"), (7, fine + " $", "fr"), (8, "A" * 4 + "b" * 96, "fr"), (9, "A" * 3 + "b" * 97, "fr"), (10, "\x0btwo\x0c words\x1c three", "en"), (11, "É" * 300, "en"), (11, fine, "en"), (4, None, "en"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    return df.selectExpr("*", *[f"'clash' AS {c}" for c in ("mask", "part", "digest", "n", "first", "good", "toxic", "filter", "step", "bit")])


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_equals_sql_on_odd_rows(spark, tmp_path):
    docs, labels = docs_of(spark), labels_of(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = op11_filter_audit(spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(ORACLE_SQL["op11_filter_audit"]).df())
    assert len(got) == 4 * 600 and set(got.part) == {"", "de", "en", "fr"}
    assert got.groupby(["part", "filter_order"]).apply(lambda g: g.sort_values("step").kept.iloc[-1], include_groups=False).groupby("part").nunique().eq(1).all()


def test_order_and_shares(spark):
    """What an order removes in all doesn't depend on it; the filters' shares of all orders add up to it."""
    out = audit.audit(audit.mask_cells(docs_of(spark), labels_of(spark))).toPandas()
    for part, g in out.groupby("part"):
        removed = g.groupby("filter_order").removed.sum()
        assert removed.nunique() == 1, part
        letter = [o[s - 1] for o, s in zip(g.filter_order, g.step, strict=True)]
        assert g.assign(letter=letter).groupby("letter").shapley.first().sum() == 120 * removed.iloc[0]


def test_other_filters_and_nothing(spark):
    cells = spark.createDataFrame([("x", 3, 2, 1, 0), ("x", 0, 5, 0, 0)], "part string, mask int, n long, n_good long, n_toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in audit.audit(cells, "PQ").collect()}
    assert got == {("PQ", 1): (5, 2, 0, 0, 1, 2), ("PQ", 2): (5, 0, 2, 0, 0, 2), ("QP", 1): (5, 2, 0, 0, 1, 2), ("QP", 2): (5, 0, 2, 0, 0, 2)}
    docs, labels = docs_of(spark), labels_of(spark)
    assert audit.audit(audit.mask_cells(docs.limit(0), labels)).count() == 0
    bare = audit.audit(audit.mask_cells(docs, labels.limit(0)))
    assert bare.selectExpr("sum(good_lost + toxic_lost)").first()[0] == 0


@pytest.mark.parametrize(("text", "mask"), [("", 1), (" \n ", 1), ("a " * 200, 2), ("w%", 9), ("ABCD", 5)])
def test_masks(spark, text, mask):
    from pyspark.sql import functions as F

    assert spark.range(1).select(audit.text_mask(F.lit(text))).first()[0] == mask
