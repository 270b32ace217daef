"""Named queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseam.plans import chunk_queries, relational_queries, search_queries, text_queries

_ALL = text_queries.QUERIES | search_queries.QUERIES | relational_queries.QUERIES | chunk_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid search, from vectors to cited and packed evidence."""
    return _ALL["hybrid_rerank"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
