"""Readers: JSON lines, CSV, Parquet, Markdown sections, catalogues and embeddings, with their contracts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numbers import number
from ..operators.relational import ContractError, require_columns, require_unique
from .lines import parsed_lines

CHUNK_SCHEMA = (
    "doc_id string, chunk_id string, text string, year int, source string, company string, ticker string, sic string, sic2 string, industry string, item string, token_count int, chunk_start_token int, chunk_end_token int, "
    "source_doc_id string, raw_id string, original_file string, record_position long, original_token_count int, chunk_count int, was_chunked boolean, filing_date string, form_type string"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may be a pattern, names anything, on any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def locate(spark: SparkSession, root: str, patterns: dict[str, str]) -> dict[str, str]:
    """A path pattern per source below root; an error names every source without files."""
    paths = {name: f"{root}/{pattern}" for name, pattern in patterns.items()}
    missing = [name for name, path in paths.items() if not exists(spark, path)]
    if missing:
        raise ContractError(f"no input files for: {', '.join(sorted(missing))}")
    return paths


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields of each JSON line with its file and physical line number (from 1); blank lines are left out, bad ones have NULL fields.

    Files are read in splits (lines.numbered_lines); lines.line_counts says how many lines were blank or bad.
    """
    return parsed_lines(spark, path, schema).where(~F.col("is_blank")).select("original_file", "record_position", "r.*")


def records(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """Rows of a CSV, JSON, JSON-lines or Parquet path; the kind comes from the suffix.

    Of JSON lines malformed ones are skipped, as a look-up table wants it; lines.line_counts says how many they are.
    """
    kind = kind or path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if kind == "json":
        return reader.option("multiLine", "true").json(path)
    if kind == "jsonl":
        return reader.option("mode", "DROPMALFORMED").json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ContractError(f"unknown kind of input: {kind}")


def subgroup_tables(spark: SparkSession, root: str, name: str, schema: str, wanted: list[str] | None = None) -> DataFrame:
    """The table of a name below each folder of root, with the folder's name as subgroup, read in one pass.

    name is a file or a folder of parts, its suffix says of what kind. wanted: subgroups that must have the table; only
    these are read. An error names those that lack it.
    """
    missing = [s for s in wanted or [] if not exists(spark, f"{root}/{s}/{name}")]
    if missing:
        raise ContractError(f"no {name} for: {', '.join(sorted(missing))}")
    pattern = f"{{{','.join(wanted)}}}" if wanted else "*"
    rows = records(spark, f"{root}/{pattern}/{name}", name.rsplit(".", 1)[-1].lower(), schema)
    folder = F.regexp_extract("_metadata.file_path", f"/([^/]+)/{re.escape(name)}(?:/|$)", 1)
    return rows.select(folder.alias("subgroup"), *rows.columns)


def tolerant_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV, or an empty frame of its schema if there is none."""
    return records(spark, path, "csv", schema) if exists(spark, path) else spark.createDataFrame([], schema)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last."""
    own = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as whole numbers; rows without one drop out."""
    for c in columns:
        df = df.withColumn(c, number(F.col(c)).cast("long"))
    return df.dropna(subset=columns)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for nothing in files; here NULL does."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """Each paragraph line of a Markdown file with the headings of levels 2 to 4 above it."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{2,4})\s", 1))
    own = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_l", level)
    for n in (2, 3, 4):
        title = F.when(F.col("_l") == n, F.trim(F.regexp_replace("line", r"^#+\s*", ""))).when((F.col("_l") > 0) & (F.col("_l") < n), F.lit(""))
        lines = lines.withColumn(f"h{n}", F.coalesce(F.last(title, ignorenulls=True).over(own), F.lit("")))
    return lines.where((F.col("_l") == 0) & (F.trim("line") != "")).select("file", "h2", "h3", "h4", F.col("i").alias("line_number"), F.trim("line").alias("text"))


def catalogue(df: DataFrame) -> DataFrame:
    """A label catalogue: required columns, unique ids and codes, in the order of the ids."""
    require_columns(df, ["topic_id", "topic_code", "topic_name", "topic_definition"])
    require_unique(df, ["topic_id"])
    require_unique(df, ["topic_code"])
    return df.orderBy("topic_id")


def descriptors(df: DataFrame, column: str) -> DataFrame:
    """A row per bullet line of a catalogue's descriptor text, numbered from 0, and the number of them."""
    parts = F.filter(F.transform(F.split(column, r"\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s*[-*•]\s*", ""))), lambda p: p != "")
    return df.withColumn("_p", parts).select("*", F.size("_p").alias("element_count"), F.posexplode("_p").alias("element_number", "element")).drop("_p")


def embeddings(df: DataFrame, expected: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors keyed by id; every expected id must have one of the same width."""
    require_unique(df, [key])
    if expected.join(df, key, "left_anti").take(1):
        raise ContractError("rows without a vector")
    if df.select(F.size(vector)).distinct().limit(2).count() > 1:
        raise ContractError("vectors of several widths")
    return df
