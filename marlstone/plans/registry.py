"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import catalog_queries, container_queries, graph_queries, rule_queries, source_queries, text_queries, web_queries

_MODULES = (text_queries, graph_queries, web_queries, rule_queries, catalog_queries, source_queries, container_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked by tf-idf against a query."""
    return text_queries.tfidf_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.ORACLES.items()}
