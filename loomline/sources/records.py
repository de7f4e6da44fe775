"""Raw records of the three kinds of source as one schema, with filters and counts of what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import SECTORS, industry, sector, whole
from ..functions.text import blank_to_null, html_paragraphs, join_paragraphs, normalize_text

FIRST_YEAR = 2000


# What a document's id begins with, by source.
ID_PREFIX = {"media": "media", "academic": "paper", "corporate": "10k"}


def standard(rows: DataFrame, source: str) -> DataFrame:
    """doc_id, source, year, text, paragraphs and, of company filings, company, ticker, sic, item, filing_date and form_type.

    original_file and record_position (readers.json_lines) are kept where the rows have them; the id of a news item, whose
    own id may repeat, ends with its line then.
    """
    numbered = "record_position" in rows.columns
    filing = source == "corporate"
    has = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    body = html_paragraphs("content") if filing else F.array(normalize_text("document"))
    out = rows.select(
        F.concat_ws("::", F.lit(ID_PREFIX[source]), F.col("id").cast("string"), *([F.concat(F.lit("row_"), F.col("record_position").cast("string"))] if numbered and source == "media" else [])).alias("doc_id"),
        F.lit(source).alias("source"),
        whole(F.col("year")).cast("int").alias("year"),
        F.filter(body, lambda p: F.trim(p) != "").alias("paragraphs"),
        F.col("id").cast("string").alias("raw_id"),
        F.col("id").cast("string").alias("source_doc_id"),
        has("original_file").alias("original_file"),
        has("record_position").cast("long").alias("record_position"),
        blank_to_null(has("company")).alias("company"),
        blank_to_null(has("ticker")).alias("ticker"),
        blank_to_null(has("sic_primary")).alias("sic"),
        blank_to_null(has("item")).alias("item"),
        blank_to_null(has("webPublicationDate")).alias("filing_date"),
        blank_to_null(has("formType")).alias("form_type"),
    )
    out = out.withColumn("sic2", sector(F.col("sic"))).withColumn("industry", industry(F.col("sic2")))
    return out.withColumn("text", join_paragraphs(F.col("paragraphs")))


def drop_reason(first_year: int = FIRST_YEAR) -> Column:
    """Why a standard record drops out, NULL if it stays."""
    return (
        F.when(F.col("year").isNull(), "no_year")
        .when(F.col("year") < first_year, "before_first_year")
        .when((F.col("source") == "corporate") & ~F.coalesce(F.col("sic2").isin(list(SECTORS)), F.lit(False)), "sector_not_allowed")
        .when(F.trim("text") == "", "empty_text")
    )


def kept(records: DataFrame) -> DataFrame:
    return records.where(drop_reason().isNull())


def drop_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source", F.coalesce(drop_reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
