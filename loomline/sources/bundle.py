"""Sets of tables that belong together: written, checked and read as one version.

A bundle is a folder per version with a Parquet table each and a manifest, which is written last: what has no manifest
does not exist for readers. Keys and references between the tables are checked on what was written, before the manifest.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ContractError
from ..storage import join_bounded
from .readers import exists


@dataclasses.dataclass(frozen=True)
class Reference:
    """Every non-NULL value of column in table is one of other_column in other."""

    table: str
    column: str
    other: str
    other_column: str


_loaded: dict[tuple[str, str, str], dict[str, DataFrame]] = {}


def broken_references(tables: dict[str, DataFrame], references: list[Reference]) -> dict[Reference, int]:
    """How many distinct values of each reference have no target; those without any are left out."""
    out = {}
    for r in references:
        own = tables[r.table].select(F.col(r.column).alias("v")).where(F.col("v").isNotNull()).distinct()
        known = tables[r.other].select(F.col(r.other_column).alias("v")).distinct()
        n = join_bounded(own, known, ["v"], "left_anti").count()
        if n:
            out[r] = n
    return out


def repeated_keys(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, int]:
    """How many keys of a table stand in several rows."""
    counts = {name: tables[name].groupBy(*columns).count().where("count > 1").count() for name, columns in keys.items()}
    return {name: n for name, n in counts.items() if n}


def write_bundle(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[Reference], facts: dict | None = None) -> str:
    """The new version's token. Repeated keys or broken references are refused: then there is no manifest."""
    token = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{token}/{name}")
    held = {name: spark.read.schema(df.schema).parquet(f"{root}/{token}/{name}") for name, df in tables.items()}
    repeated = repeated_keys(held, keys)
    if repeated:
        raise ContractError(f"keys in several rows: {repeated}")
    broken = broken_references(held, references)
    if broken:
        raise ContractError("; ".join(f"{r.table}.{r.column} has {n} values that are not in {r.other}.{r.other_column}" for r, n in broken.items()))
    manifest = {"facts": facts or {}, "row_counts": {name: df.count() for name, df in held.items()}, "schemas": {name: df.schema.json() for name, df in held.items()}, "token": token}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/{token}/manifest")
    return token


def read_manifest(spark: SparkSession, root: str, token: str) -> dict | None:
    """None of a version that was not written to its end."""
    path = f"{root}/{token}/manifest"
    return json.loads(spark.read.text(path).first()[0]) if exists(spark, f"{path}/_SUCCESS") else None


def load_bundle(spark: SparkSession, root: str, token: str, required: list[str], optional: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of a version and no name, or no table and the names of what is missing.

    optional: name -> schema of tables that may be missing and are empty then. A table whose rows are not as many as the
    manifest says is refused. What was loaded under a token is kept for it.
    """
    kept = _loaded.get((spark.sparkContext.applicationId, root, token))
    if kept is not None and all(name in kept for name in required):
        return kept, []
    manifest = read_manifest(spark, root, token)
    if manifest is None:
        return {}, ["manifest"]
    missing = [name for name in required if not exists(spark, f"{root}/{token}/{name}")]
    if missing:
        return {}, missing
    tables = {}
    for name in [*required, *(optional or {})]:
        if not exists(spark, f"{root}/{token}/{name}"):
            tables[name] = spark.createDataFrame([], optional[name])
            continue
        tables[name] = spark.read.parquet(f"{root}/{token}/{name}")
        n = tables[name].count()
        if n != manifest["row_counts"].get(name):
            raise ContractError(f"{name} has {n} rows, not {manifest['row_counts'].get(name)}")
    _loaded[(spark.sparkContext.applicationId, root, token)] = tables
    return tables, []
