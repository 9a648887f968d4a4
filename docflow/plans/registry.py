"""Queries over the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docflow.plans import retrieval_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.QUERIES | retrieval_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | retrieval_queries.SQL
