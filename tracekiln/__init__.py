"""tracekiln: curation, scoring, voting and profiling of problem-solving
traces as Spark DataFrame / Column operators."""

from .sources.tables import TABLES


def tables_for_duckdb():
    return TABLES


__all__ = ["TABLES", "tables_for_duckdb"]
