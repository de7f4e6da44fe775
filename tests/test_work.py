"""Numbered lines, committed batches, rounds of attempts and statistics of runs."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators.relational import ContractError
from loomline.sources import lines, readers, records
from loomline.streaming import attempts
from loomline.streaming.versions import VersionedTable


def physical(text):
    out = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return out[:-1] if out and out[-1] == "" else out


@pytest.mark.parametrize("size", [64, 1000, 1 << 27])
def test_line_numbers_at_any_split_size(spark, tmp_path, size):
    draw, want = random.Random(7), {}
    for name in ("a", "b", "empty"):
        text = "".join(draw.choice(['{"id": "x%d"}', "", "  ", "bad%d", '{"id": "é%d", "t": "long ' + "y" * 90 + '"}']).replace("%d", str(i)) + draw.choice(["\n", "\r\n"]) for i in range(80)) if name != "empty" else ""
        (tmp_path / f"{name}.jsonl").write_bytes((text + ("no end" if name == "b" else "")).encode())
        want |= {(f"{name}.jsonl", i): line for i, line in enumerate(physical(text + ("no end" if name == "b" else "")), 1)}
    with gzip.open(tmp_path / "z.jsonl.gz", "wb") as f:
        f.write(b"one\n\ntwo\n")
    want |= {("z.jsonl.gz", 1): "one", ("z.jsonl.gz", 2): "", ("z.jsonl.gz", 3): "two"}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
        assert len(got) == len(want) and {(r.original_file, r.record_position): r.line for r in got} == want
        counts = {r.original_file: (r.lines, r.blank, r.malformed, r.records) for r in lines.line_counts(spark, str(tmp_path), "id string").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("a.jsonl", "b.jsonl"):
        own = [line for (f, _), line in want.items() if f == name]
        blank, good = sum(not x.strip() for x in own), sum(x.startswith("{") for x in own)
        assert counts[name] == (len(own), blank, len(own) - blank - good, good)


def test_records_keep_their_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('\n{"id": "7", "year": 2005, "document": "a"}\nbad\n{"id": "7", "year": 2006, "document": "b"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "m.jsonl"), "id string, year int, document string").where("id IS NOT NULL")
    got = {r.record_position: (r.doc_id, r.original_file, r.source_doc_id) for r in records.standard(rows, "media").collect()}
    assert got == {2: ("media::7::row_2", "m.jsonl", "7"), 4: ("media::7::row_4", "m.jsonl", "7")}
    assert records.standard(rows, "academic").first().doc_id == "paper::7"


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_versions_and_restore(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id long")
    assert table.read().count() == 0 and table.version().number == 0
    table.append(spark.range(3), name="first", facts={"model": "m"})
    table.append(spark.range(3, 5))
    table.append(spark.range(0))
    assert ids(table.read()) == [0, 1, 2, 3, 4] and ids(table.read("first")) == [0, 1, 2] and table.version("first").facts == {"model": "m"}
    assert [v.rows for v in table.versions()] == [3, 5, 5]
    table.restore("first")
    table.append(spark.range(9, 10))
    assert ids(table.read()) == [0, 1, 2, 9] and table.version().rows == 4 and ids(table.read(2)) == [0, 1, 2, 3, 4]
    assert table.snapshot(str(tmp_path / "s"), 2) == 5
    other = VersionedTable(spark, str(tmp_path / "u"), "id long")
    assert other.restore_snapshot(str(tmp_path / "s")).rows == 5 and ids(other.read()) == [0, 1, 2, 3, 4]
    spark.range(1).write.mode("append").parquet(str(tmp_path / "s/rows"))
    with pytest.raises(ContractError, match="6 rows, not 5"):
        other.restore_snapshot(str(tmp_path / "s"))
    lost = table.version("first").batches[0][0]
    spark.range(2).write.mode("overwrite").parquet(f"{tmp_path}/t/{lost}")
    with pytest.raises(ContractError, match="2 rows, not 3"):
        table.restore("first")
    with pytest.raises(ContractError):
        table.version("never")


def test_work_that_dies_between_write_and_commit(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path), "id long")
    table.append(spark.range(2))

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", die)
        with pytest.raises(Killed):
            table.append(spark.range(100))
    again = VersionedTable(spark, str(tmp_path), "id long")
    assert ids(again.read()) == [0, 1] and len(again.orphans()) == 1
    (tmp_path / "log/0000000002.json").write_text('{"name": null, "bat')  # a commit that wasn't written to its end
    assert again.version().number == 1 and again.append(spark.range(2, 3)).number == 3
    assert ids(again.read()) == [0, 1, 2] and again.drop_orphans() == 1 and again.orphans() == [] and again.check().rows == 3


def test_long_logs_and_other_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomline.streaming.versions.WHOLE_EVERY", 3)
    a, b = (VersionedTable(spark, str(tmp_path), "id long") for _ in range(2))
    names = VersionedTable._names
    stale = names(a, "log")
    for i in range(4):
        (a if i % 2 else b).append(spark.range(i, i + 1))
    taken = iter([stale])
    monkeypatch.setattr(a, "_names", lambda folder: next(taken, None) or names(a, folder) if folder == "log" else names(a, folder))
    assert a.append(spark.range(4, 5)).number == 5
    assert ids(b.read()) == [0, 1, 2, 3, 4] and [len(v.batches) for v in b.versions()] == [1, 2, 3, 4, 5]


@pytest.fixture
def answer():
    def reply(prompts):
        """Fails with a batch that has 'crash' in it; answers the third prompt of 'late' only, never 'never'."""
        if any("crash" in p for p in prompts):
            raise RuntimeError("out of memory")
        return ["yes" if p == "now" or p.endswith("##") and "late" in p else "hm" for p in prompts]

    return reply


def test_rounds_of_attempts(spark, tmp_path, answer):
    questions = spark.createDataFrame([("a", "now"), ("b", "late"), ("c", "never"), ("d", "crash")], "key string, prompt string")
    ledger = VersionedTable(spark, str(tmp_path), attempts.LEDGER)
    run = lambda: attempts.ask_in_rounds(questions, answer, ledger, lambda a: a == "yes", ["#", "##"], batches=2)
    facts = run()
    got = {r.key: (r.attempt, r.state, r.answer, r.error) for r in attempts.results(questions, ledger).collect()}
    assert got == {"a": (1, "done", "yes", None), "b": (3, "done", "yes", None), "c": (3, "given_up", "hm", "the answer can't be used"), "d": (3, "given_up", None, "RuntimeError: out of memory")}
    rows = ledger.read()
    assert facts["attempts_this_run"] == rows.count() == 10 and facts["failed_attempts_this_run"] == rows.where("state <> 'done'").count() == 8
    assert (facts["total_input_rows"], facts["rows_in_output"], facts["error_rows"], facts["resumed_rows"]) == (4, 2, 2, 0)
    assert facts["rows_per_minute"] == pytest.approx(600 / facts["elapsed_seconds"], rel=0.01)
    more = run()
    assert more["attempts_this_run"] == 0 and more["resumed_rows"] == 4


def test_rounds_go_on_where_they_ended(spark, tmp_path, monkeypatch, answer):
    questions = spark.createDataFrame([(str(i), "late") for i in range(6)], "key string, prompt string")
    ledger = VersionedTable(spark, str(tmp_path), attempts.LEDGER)
    append, calls = VersionedTable.append, []

    def second_dies(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return append(self, *args, **kwargs)

    monkeypatch.setattr(VersionedTable, "append", second_dies)
    with pytest.raises(KeyboardInterrupt):
        attempts.ask_in_rounds(questions, answer, ledger, lambda a: a == "yes", ["#", "##"])
    facts = attempts.ask_in_rounds(questions, answer, ledger, lambda a: a == "yes", ["#", "##"])
    assert facts["rows_in_output"] == 6 and ledger.read().groupBy("key").count().where("count <> 3").count() == 0


def test_answers_that_can_be_used(spark):
    whole = '{"same_issue_assessment": "Same-Issue", "discourse_function_relation": "similar", "function_label_a": "ESG finance", "function_label_b": "unclear", "difference_summary": "d", "keep_for_discourse_analysis": %s, "confidence_note": "c"%s}'
    cases = [(whole % ("true", ""), True, True), (whole % ('"Yes"', ', "temporal_interpretation_note": "NA"'), True, True), (whole % ("null", ""), True, False), (whole.replace('"d"', '"none"') % ("1", ""), False, True), ("{}", False, False), (None, False, None), ("no json", False, None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string").withColumn("f", attempts.compared(F.col("a")))
    got = {r.i: (r.ok, r.keep, r.note, r.label) for r in rows.select("i", attempts.is_ready(F.col("f")).alias("ok"), F.col(f"f.{attempts.KEEP}").alias("keep"), F.col("f.temporal_interpretation_note").alias("note"), F.col("f.function_label_a").alias("label")).collect()}
    assert [got[i][0] for i in range(7)] == [c[1] for c in cases]
    assert [bool(got[i][1]) for i in range(4)] == [True, True, False, True]
    assert (got[0][2], got[1][2], got[0][3]) == ("Not applicable", "NA", "financial_investor")


def test_live_statistics_equal_counts(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame([(i, None if i % 4 else "e", 1 + i % 3) for i in range(part * 10, part * 10 + 10)], "id long, error string, attempt int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = attempts.LiveStatistics()
    spark.streams.addListener(live)
    try:
        stream = spark.readStream.schema("id long, error string, attempt int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = stream.observe(live.NAME, *live.metrics(F.col("error").isNotNull(), F.col("attempt")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(live)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert (live.rows, live.errors, live.retries) == (out.count(), out.where("error IS NOT NULL").count(), out.where("attempt > 1").count()) == (30, 8, 20)
    assert live.batches == 3 and live.rows_per_minute > 0


def test_an_answer_is_parsed_once(spark):
    """its JSON was parsed for every field and class that is looked at, its text for every word of a class."""
    ready = str(attempts.is_ready(attempts.compared(F.col("answer"))))
    assert ready.count("from_json") == 1 and ready.count("regexp_replace") <= 30
    rows = spark.createDataFrame([("{}",), (None,), ("[",)], "answer string")
    assert [r[0] for r in rows.select(attempts.is_ready(attempts.compared(F.col("answer")))).collect()] == [False] * 3
