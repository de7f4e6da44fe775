"""Pages go through Python a few at a time, whatever the size of an Arrow batch."""

from __future__ import annotations

import pyarrow as pa

from loomline.functions import text
from loomline.operators import chunking


def test_a_batch_is_cut():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["id"])
    parts = list(chunking.slices(iter([batch])))
    assert max(p.num_rows for p in parts) <= chunking.SLICE < 1000
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(1000))


def test_paragraphs_of_many_pages(spark):
    pages = [(i, None if i % 7 == 0 else f"<p>one {i}</p><p>two</p>" if i % 2 else f"text {i}") for i in range(400)]
    got = chunking.page_paragraphs(spark.createDataFrame(pages, "id int, html string").coalesce(1), "id", "html")
    assert got.schema["id"].dataType.simpleString() == "int"
    assert {r.id: r.paragraphs for r in got.collect()} == {i: text.paragraphs_of(h) for i, h in pages}
    assert chunking.paragraph_chunks(got, "id", "paragraphs", 64, 8, 2).count() == sum(h is not None for _, h in pages)


def test_chunks_of_pages_take_one_python_pass(spark):
    pages = [(i, None if i % 7 == 0 else f"<p>one {i}</p><p>" + "word " * (i % 90) + "</p>") for i in range(400)]
    rows = spark.createDataFrame(pages, "id int, html string")
    got = chunking.page_chunks(rows, "id", "html", 64, 8, 2)
    want = chunking.paragraph_chunks(chunking.page_paragraphs(rows, "id", "html"), "id", "paragraphs", 64, 8, 2)
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
