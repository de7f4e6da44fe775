"""Queries over the tables of a data folder, and their SQL."""

from . import app, comparisons, decisions, encoding, merged, narratives, quality, relational, reports, review, sampling, series, serving, support, text, topics, vectors, work
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "app", "comparisons", "decisions", "encoding", "merged", "narratives", "quality", "relational", "reports", "review", "sampling", "series", "serving", "support", "text", "topics", "vectors", "work"]
