"""The registered queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import document_queries, expression_queries, pdf_files, pdf_graphics, pdf_locked, pdf_queries, relational_queries


MODULES = (expression_queries, relational_queries, document_queries, pdf_queries, pdf_files, pdf_graphics, pdf_locked)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
