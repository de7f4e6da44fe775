"""Writers: tables by suffix, one dataset per sheet, manifests with counts, small Markdown tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ContractError


def write(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header, JSON lines or Parquet, by the suffix of the path; a directory with a commit protocol."""
    kind = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", "true").option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        raise ContractError(f"unknown kind of output: {kind}")
    return path


def write_sheets(sheets: dict[str, DataFrame], root: str) -> dict[str, str]:
    """A dataset per sheet below root."""
    return {name: write(printable(df), f"{root}/{name}.csv") for name, df in sheets.items()}


def printable(df: DataFrame) -> DataFrame:
    """Strings without control signs, which sheets cannot hold."""
    return df.withColumns({c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "") for c, kind in df.dtypes if kind == "string"})


def manifest(spark: SparkSession, path: str, facts: dict, tables: dict[str, str]) -> dict:
    """Facts, paths and row counts as one JSON line, keys sorted."""
    out = {**facts, "outputs": dict(sorted(tables.items())), "rows": {k: (spark.read.option("header", "true").csv(p) if p.endswith(".csv") else spark.read.parquet(p) if p.endswith(".parquet") else spark.read.json(p)).count() for k, p in sorted(tables.items())}}
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def check_rows(spark: SparkSession, expected: dict[str, int], paths: dict[str, str]) -> None:
    """Restored tables must have the rows that they had."""
    for name, n in expected.items():
        found = spark.read.parquet(paths[name]).count()
        if found != n:
            raise ContractError(f"{name} has {found} rows, not {n}")


def write_embedding_subset(vectors: DataFrame, wanted: DataFrame, key: str, path: str) -> int:
    """The vectors of the wanted keys as a Parquet table; how many there are. Refused if a key has no vector, or several."""
    keys = wanted.select(key).distinct()
    vectors.join(keys, key, "left_semi").write.mode("overwrite").parquet(path)
    found, n = vectors.sparkSession.read.parquet(path).count(), keys.count()
    if found != n:
        raise ContractError(f"{found} vectors for {n} keys")
    return found


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small table as Markdown, at most limit rows in the order given."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
