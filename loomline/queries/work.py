"""Lines of files and answers of models: work whose state lies in files that Spark writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.corpus import table
from ..sources import lines
from ..storage import shared_folder
from ..streaming import attempts
from ..streaming.versions import VersionedTable
from .registry import query

#: Conversations of a file of JSON lines.
PER_FILE = 1000


def _jsonl(spark: SparkSession, sf_dir: str) -> str:
    """Turns as JSON lines in their order, a blank line before every third turn, a broken one before every fifth."""
    turn = F.col("turn")
    line = F.concat(F.when(turn % 3 == 0, "\n").otherwise(""), F.when(turn % 5 == 0, '{"conv_id": \n').otherwise(""), F.to_json(F.struct("conv_id", "turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").withColumn("part", F.floor(F.col("conv_id") / PER_FILE).cast("long"))
    path = f"{shared_folder(spark)}/lines/{uuid.uuid4().hex}"
    rows.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", line.alias("value")).write.partitionBy("part").text(path)
    return path


_LINES_SQL = f"t AS (SELECT conv_id, turn, conv_id // {PER_FILE} AS part, CAST(turn % 3 = 0 AS INTEGER) AS blank, CAST(turn % 5 = 0 AS INTEGER) AS bad FROM conversations)"


@query(f"WITH {_LINES_SQL} SELECT conv_id, turn, CAST(sum(1 + blank + bad) OVER (PARTITION BY part ORDER BY conv_id, turn) AS BIGINT) AS record_position FROM t")
def jsonl_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read from JSON lines with their physical line in the file."""
    rows = lines.parsed_lines(spark, _jsonl(spark, sf_dir), "conv_id long, turn int, role string, text string")
    return rows.where(~F.col("is_blank") & ~F.col("is_malformed")).select("r.conv_id", F.col("r.turn").alias("turn"), "record_position")


@query(f"WITH {_LINES_SQL} SELECT part, CAST(sum(1 + blank + bad) AS BIGINT) AS lines, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(bad) AS BIGINT) AS malformed, count(*) AS records FROM t GROUP BY part")
def jsonl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical, blank and malformed lines and records of each file."""
    counts = lines.line_counts(spark, _jsonl(spark, sf_dir), "conv_id long, turn int, role string, text string")
    return counts.select(F.regexp_extract("file_path", "part=([0-9]+)", 1).cast("long").alias("part"), "lines", "blank", "malformed", "records")


# A model that is asked with a whole text and answers by its length: some answers can't be used at first, some never.
_SAME, _RELATION = ["Same issue", "an adjacent topic", "weak link", "YES"], ["similar function", "none of both", "mixed"]
_LABELS = ["technical research", "Policy/Governance", "media debate", "hybrid"]


def _model(prompts: list[str]) -> list[str]:
    out = []
    for prompt in prompts:
        question, second, _ = prompt.partition(attempts.RETRY)
        question, third, _ = question.partition(attempts.SCHEMA_RETRY)
        n = len(question)
        fields = {"same_issue_assessment": _SAME[n % 4], "discourse_function_relation": _RELATION[n % 3], "function_label_a": _LABELS[n % 4], "function_label_b": _LABELS[n % 3], "difference_summary": f"of {n} signs", "temporal_interpretation_note": "n/a" if n % 2 else None, "keep_for_discourse_analysis": n % 2 == 0, "confidence_note": "sure"}
        if n % 12 == 0:
            fields["same_issue_assessment"] = "perhaps"
        if n % 6 == 0 and second:
            del fields["difference_summary"]
        out.append("I can't say {" if n % 3 == 0 and not second and not third else f"Here it is: {json.dumps(fields)} Thanks")
    return out


@query(
    """WITH q AS (SELECT CAST(conv_id AS VARCHAR) AS key, length(coalesce(arg_max(text, turn), '')) AS n FROM conversations GROUP BY conv_id)
SELECT key, CAST(CASE WHEN n % 6 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt, CASE WHEN n % 12 = 0 THEN 'given_up' ELSE 'done' END AS state, CASE WHEN n % 12 = 0 THEN 'perhaps' ELSE (['same_issue', 'adjacent_issue', 'weak_match', 'same_issue'])[n % 4 + 1] END AS same_issue_assessment,
(['same_function', 'different_function', 'unclear'])[n % 3 + 1] AS discourse_function_relation, (['technical_research', 'policy_governance', 'public_political_debate', 'mixed_or_unclear'])[n % 4 + 1] AS function_label_a, (['technical_research', 'policy_governance', 'public_political_debate'])[n % 3 + 1] AS function_label_b,
'of ' || n || ' signs' AS difference_summary, CASE WHEN n % 2 = 1 THEN 'n/a' ELSE 'Not applicable' END AS temporal_interpretation_note, n % 2 = 0 AS keep_for_discourse_analysis FROM q"""
)
def pair_answer_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about conversations, asked again with stricter prompts where they can't be used, in their classes."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    questions = last.select(F.col("conv_id").cast("string").alias("key"), F.coalesce("t", F.lit("")).alias("prompt"))
    ledger = VersionedTable(spark, f"{shared_folder(spark)}/ledgers/{uuid.uuid4().hex}", attempts.LEDGER)
    fields = lambda answer: attempts.compared(text.extract_json_object(answer))
    attempts.ask_in_rounds(questions, _model, ledger, lambda answer: attempts.is_ready(fields(answer)), [attempts.RETRY, attempts.schema_prompt(["key"])])
    out = attempts.results(questions, ledger).withColumn("f", fields(F.col("answer")))
    return out.select("key", "attempt", "state", *[F.col(f"f.{c}").alias(c) for c in (*attempts.CLASSES, *attempts.TEXTS[:2], attempts.KEEP)])
