"""Work in parts that can be taken up again: what has an answer is not asked twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import resume


def validate(rows: DataFrame, key: str, text: str, ask: Callable[[list[str]], list[str]]) -> DataFrame:
    """key and verdict for each row; ask answers a batch, row by row where a batch fails, and an answer that fails is NULL."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            try:
                answers: list[str | None] = list(ask(texts))
                if len(answers) != len(texts):
                    raise ValueError("as many answers as questions are wanted")
            except Exception:
                answers = []
                for t in texts:
                    try:
                        answers.append(ask([t])[0])
                    except Exception:
                        answers.append(None)
            yield pd.DataFrame({key: frame[key], "answer": answers})

    return rows.select(F.col(key).cast("long"), text).mapInPandas(run, f"{key} long, answer string")


def validate_rest(rows: DataFrame, done: DataFrame, key: str, text: str, ask: Callable[[list[str]], list[str]], path: str) -> DataFrame:
    """Appends answers for the rows without one to the table at path, and returns all answers."""
    validate(resume(rows, done, key), key, text, ask).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def validate_stream(stream: DataFrame, key: str, text: str, ask: Callable[[list[str]], list[str]], path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream of rows: each micro-batch leaves out what the table has, so a repeated batch adds nothing."""

    def take(batch: DataFrame, _: int) -> None:
        try:
            done = batch.sparkSession.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            done = batch.select(key).limit(0)
        validate(resume(batch.dropDuplicates([key]), done, key), key, text, ask).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
