import pytest
from pyspark.sql import functions as F

from loomline.operators.relational import ContractError
from loomline.sources import readers, records, writers
from loomline.streaming import resume


def test_json_lines_keep_physical_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "year": 2001}\n\nbad\n{"id": "y"}\n')
    got = readers.json_lines(spark, str(tmp_path), "id string, year int").orderBy("record_position")
    assert [(r.record_position, r.id, r.year) for r in got.collect()] == [(1, "x", 2001), (3, None, None), (4, "y", None)]


def test_locate(spark, tmp_path):
    (tmp_path / "media.jsonl").write_text("{}")
    with pytest.raises(ContractError, match="academic"):
        readers.locate(spark, str(tmp_path), {"media": "media*.jsonl", "academic": "academic*.jsonl"})


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("## A\nx\n### B\ny\n## C\nz\n")
    got = readers.markdown_sections(spark, str(tmp_path / "a.md")).orderBy("line_number")
    assert [(r.h2, r.h3, r.text) for r in got.collect()] == [("A", "", "x"), ("A", "B", "y"), ("C", "", "z")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', 1.5), (2, None, None)], "id long, t string, x double")
    for kind in ("csv", "jsonl", "parquet"):
        path = writers.write(df, f"{tmp_path}/t.{kind}")
        back = readers.records(spark, path, kind, "id long, t string, x double")
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert readers.tolerant_csv(spark, f"{tmp_path}/none.csv", "a int").count() == 0
    facts = writers.manifest(spark, f"{tmp_path}/m", {"threshold": 0.7}, {"t": f"{tmp_path}/t.parquet"})
    assert facts["rows"] == {"t": 2}
    with pytest.raises(ContractError):
        writers.check_rows(spark, {"t": 3}, {"t": f"{tmp_path}/t.parquet"})
    assert "| 1 |" in writers.markdown_table(df.select("id").orderBy("id"))


def test_tables_of_subgroups(spark, tmp_path):
    for name, ids in (("media_T1", [1, 2]), ("academic_T1", [3]), ("media_T2", [4])):
        rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string")
        writers.write(rows, f"{tmp_path}/{name}/topics.parquet")
        (tmp_path / name / "info.csv").write_text("id,t\n" + "".join(f"{i},t{i}\n" for i in ids))
    for table in ("topics.parquet", "info.csv"):
        got = readers.subgroup_tables(spark, str(tmp_path), table, "id long, t string")
        assert sorted((r.subgroup, r.id) for r in got.collect()) == [("academic_T1", 3), ("media_T1", 1), ("media_T1", 2), ("media_T2", 4)]
        some = readers.subgroup_tables(spark, str(tmp_path), table, "id long, t string", ["media_T1", "media_T2"])
        assert sorted(r.id for r in some.collect()) == [1, 2, 4]
    with pytest.raises(ContractError, match="corporate_T9"):
        readers.subgroup_tables(spark, str(tmp_path), "info.csv", "id long, t string", ["media_T1", "corporate_T9"])


def test_subset_of_embeddings(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, v array<double>")
    wanted = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    assert writers.write_embedding_subset(vectors, wanted, "id", f"{tmp_path}/v") == 2
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/v").collect()) == [1, 3]
    with pytest.raises(ContractError, match="2 vectors for 3 keys"):
        writers.write_embedding_subset(vectors, wanted.union(spark.createDataFrame([(9,)], "id long")), "id", f"{tmp_path}/w")


def test_records(spark):
    rows = spark.createDataFrame([("1", "2005", "1311", "<p>One</p><p>Two</p>"), ("2", "1999", "1311", "<p>x</p>"), ("3", "2005", "9999", "<p>x</p>"), ("4", "x", "1311", "<p>x</p>")], "id string, year string, sic_primary string, content string")
    got = records.standard(rows, "corporate")
    assert {r.reason: r.n for r in records.drop_counts(got).collect()} == {"kept": 1, "before_first_year": 1, "sector_not_allowed": 1, "no_year": 1}
    assert records.kept(got).first().text == "One\n\nTwo"
    other = records.standard(spark.createDataFrame([("1", "2005", " a&amp;b ")], "id string, year string, document string"), "media")
    assert records.kept(other).first().text == "a&b"


def test_catalogue_and_descriptors(spark):
    df = spark.createDataFrame([(1, "T1", "n", "d", "- a\n* b\n\n")], "topic_id int, topic_code string, topic_name string, topic_definition string, bullets string")
    assert [(r.element_number, r.element, r.element_count) for r in readers.descriptors(readers.catalogue(df), "bullets").collect()] == [(0, "a", 2), (1, "b", 2)]
    with pytest.raises(ContractError):
        readers.catalogue(df.union(df))


def test_embeddings_contract(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<float>")
    assert readers.embeddings(df, df.select("id"), "id", "v").count() == 1
    with pytest.raises(ContractError):
        readers.embeddings(df, spark.range(3).select("id"), "id", "v")


@pytest.fixture
def ask():
    def answer(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("bad")
        return ["yes" if "a" in t else "no" for t in texts]

    return answer


def test_resume_asks_only_what_is_open(spark, tmp_path, ask):
    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "bad"), (4, None)], "id long, t string")
    first = resume.validate_rest(rows.where("id <= 2"), rows.limit(0), "id", "t", ask, path)
    assert sorted(map(tuple, first.collect())) == [(1, "yes"), (2, "no")]
    done = spark.createDataFrame(first.collect(), first.schema)
    every = resume.validate_rest(rows, done, "id", "t", ask, path)
    assert {r.id: r.answer for r in every.collect()} == {1: "yes", 2: "no", 3: None, 4: "no"} and every.count() == 4


def test_stream_adds_each_row_once(spark, tmp_path, ask):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, t string").parquet(source)
        resume.validate_stream(stream, "id", "t", ask, path, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "yes"), (2, "no")]
    assert spark.range(1).select(F.lit(1)).count() == 1
