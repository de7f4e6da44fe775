"""Questions to a model in rounds: a ledger of attempts, stricter prompts for answers that can't be used, and statistics.

A question is open until an answer is ready or the prompts are used up. Every attempt is a row of a versioned table, each
round of answers one commit, so work that dies asks again only what its last round had asked.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions import text
from ..storage import join_bounded
from .versions import VersionedTable

DONE, BAD, GIVEN_UP = "done", "bad", "given_up"
LEDGER = "key string, attempt int, state string, answer string, error string, seconds double"
Ask = Callable[[list[str]], list[str]]

# What is added to a prompt whose answer could not be used, then to one whose second answer couldn't.
RETRY = "\n\nFinal instruction:\nReturn exactly one valid JSON object.\nDo not use markdown fences.\nDo not add explanations before or after the JSON.\n"
SCHEMA_RETRY = "\n\nReturn exactly one valid JSON object using this schema and no other text:\n"
# The fields of a pair's comparison; those without a list of classes are texts.
CLASSES = {"same_issue_assessment": (text.SAME_ISSUE_KEYWORDS, text.SAME_ISSUE_SYNONYMS), "discourse_function_relation": (text.RELATION_KEYWORDS, ()), "function_label_a": (text.FUNCTION_KEYWORDS, ()), "function_label_b": (text.FUNCTION_KEYWORDS, ())}
TEXTS = ["difference_summary", "temporal_interpretation_note", "confidence_note"]
KEEP = "keep_for_discourse_analysis"
NO_NOTE = "Not applicable"


def schema_prompt(own: list[str]) -> str:
    """The second retry's instruction with an empty answer; own: names of the fields that repeat the question's."""
    fields = [*[f'  "{f}": ""' for f in own], *[f'  "{f}": ""' for f in CLASSES], f'  "{TEXTS[0]}": ""', f'  "{TEXTS[1]}": ""', f'  "{KEEP}": true', f'  "{TEXTS[2]}": ""']
    return SCHEMA_RETRY + "{\n" + ",\n".join(fields) + "\n}\n"


def compared(answer: Column) -> Column:
    """An answer's fields in their classes, NULL without a JSON object in it. Whether it may be used: is_ready.

    The answer is the text of its object (text.extract_json_object). Words for nothing are no text; a note on time that is
    missing is 'Not applicable', one that says nothing stays as it is.
    """
    names = [*CLASSES, *TEXTS, KEEP]
    raw = F.from_json(answer, ", ".join(f"{c} string" for c in names))

    def fields(raw: Column) -> Column:
        classes = {c: text.keyword_class(raw[c], *words) for c, words in CLASSES.items()}
        texts = {c: text.drop_nullish(raw[c]) for c in TEXTS}
        note = F.coalesce(F.nullif(texts[TEXTS[1]], F.lit("")), F.nullif(F.trim(raw[TEXTS[1]]), F.lit("")), F.lit(NO_NOTE))
        keep = F.lower(text.drop_nullish(raw[KEEP])).isin(text.KEEP_WORDS)
        every = {**classes, **texts, TEXTS[1]: note, KEEP: keep}
        return F.when(raw.isNotNull(), F.struct(*[every[c].alias(c) for c in names]))

    return F.when(answer.isNotNull(), text.bound(raw, fields))


def is_ready(fields: Column) -> Column:
    """Every text is there and every class is one of the allowed ones."""

    def every(fields: Column) -> Column:
        out = F.lit(True)
        for c, (words, _) in CLASSES.items():
            out = out & fields[c].isin([name for name, _ in words])
        for c in TEXTS:
            out = out & (fields[c] != "")
        return out

    return F.coalesce(text.bound(fields, every), F.lit(False))


def latest(ledger: DataFrame) -> DataFrame:
    """The last attempt of each key."""
    return ledger.groupBy("key").agg(F.max(F.struct("attempt", "state", "answer", "error")).alias("_l")).select("key", "_l.*")


def _answers(rows: DataFrame, ask: Ask) -> DataFrame:
    """key, attempt, answer, error and seconds; a batch that fails is asked one by one, one that fails alone has its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts, start = frame["prompt"].tolist(), time.monotonic()
            errors: list[str | None] = [None] * len(prompts)
            try:
                answers: list[str | None] = list(ask(prompts))
                if len(answers) != len(prompts):
                    raise ValueError("as many answers as questions are wanted")
            except Exception:
                answers = []
                for i, prompt in enumerate(prompts):
                    try:
                        answers.append(ask([prompt])[0])
                    except Exception as error:
                        answers.append(None)
                        errors[i] = f"{type(error).__name__}: {error}"
            each = (time.monotonic() - start) / max(1, len(prompts))
            yield pd.DataFrame({"key": frame["key"], "attempt": frame["attempt"], "answer": answers, "error": errors, "seconds": each})

    return rows.mapInPandas(run, "key string, attempt int, answer string, error string, seconds double")


def ask_in_rounds(questions: DataFrame, ask: Ask, ledger: VersionedTable, ready: Callable[[Column], Column], more: list[str], batches: int = 1) -> dict[str, int | float]:
    """Asks what is open until nothing is; gives the run's statistics.

    questions: key (unique) and prompt. more: what is added to the prompt of the second, third, ... attempt; with the first
    that makes len(more) + 1 attempts, after which a key is given up. ready: of an answer, whether it can be used. Each
    round is committed in so many batches.
    """
    most, start = len(more) + 1, time.monotonic()
    added = F.element_at(F.array(*map(F.lit, ["", *more])), F.col("attempt"))
    before, asked, failed = latest(ledger.read()).where(F.col("state") != BAD).count(), 0, 0
    for _ in range(most):
        known = latest(ledger.read()).select("key", F.col("attempt").alias("_a"), F.col("state").alias("_s"))
        open_rows = questions.join(known, "key", "left").where(F.col("_s").isNull() | (F.col("_s") == BAD))
        open_rows = open_rows.select("key", (F.coalesce("_a", F.lit(0)) + 1).cast("int").alias("attempt"), "prompt").where(F.col("attempt") <= most)
        if not open_rows.take(1):
            break
        for part in range(batches):
            some = open_rows if batches == 1 else open_rows.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == part)
            answers = _answers(some.select("key", "attempt", F.concat("prompt", added).alias("prompt")), ask)
            good = F.coalesce(ready(F.col("answer")), F.lit(False))
            state = F.when(good, DONE).when(F.col("attempt") >= most, GIVEN_UP).otherwise(BAD)
            error = F.coalesce("error", F.when(~good, "the answer can't be used"))
            seen = Observation()
            rows = answers.select("key", "attempt", state.alias("state"), "answer", error.alias("error"), "seconds")
            rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("state") != DONE).alias("errors"))
            ledger.append(rows, facts={"part": part})
            asked, failed = asked + seen.get["rows"], failed + seen.get["errors"]
    seconds = max(time.monotonic() - start, 1e-9)
    last = latest(ledger.read()).groupBy("state").count()
    states = {r["state"]: r["count"] for r in last.collect()}
    return {"total_input_rows": questions.count(), "resumed_rows": before, "attempts_this_run": asked, "failed_attempts_this_run": failed, "rows_in_output": states.get(DONE, 0), "error_rows": states.get(GIVEN_UP, 0), "elapsed_seconds": round(seconds, 3), "rows_per_minute": round(60 * asked / seconds, 3)}


def results(questions: DataFrame, ledger: VersionedTable) -> DataFrame:
    """Every question with the attempts that it took, its state and its last answer."""
    return join_bounded(questions.drop("prompt"), latest(ledger.read()), ["key"], "left")


class LiveStatistics(StreamingQueryListener):
    """Rows, errors and retries of running streams, with rows per minute, from their progress and observed metrics.

    Observe a stream under the name `run` with columns rows, errors and retries; add the listener to spark.streams.
    """

    NAME = "run"

    def __init__(self) -> None:
        self.rows = self.errors = self.retries = self.batches = 0
        self.seconds = 0.0
        self.ended = False

    @staticmethod
    def metrics(error: Column, attempt: Column) -> list[Column]:
        return [F.count(F.lit(1)).alias("rows"), F.count_if(error).alias("errors"), F.count_if(attempt > 1).alias("retries")]

    @property
    def rows_per_minute(self) -> float:
        return 60 * self.rows / self.seconds if self.seconds else 0.0

    def onQueryStarted(self, event) -> None:
        self.ended = False

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.NAME)
        self.seconds += progress.batchDuration / 1000
        if seen is not None and progress.numInputRows:
            self.batches += 1
            self.rows, self.errors, self.retries = self.rows + seen["rows"], self.errors + seen["errors"], self.retries + seen["retries"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True
