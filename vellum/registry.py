"""The queries of the library and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def modules() -> list:
    """Modules with ``QUERIES`` (name to function) and ``SQL`` (name to statement)."""
    from vellum.operators import compose, formats, forms, html, intel, markdown, orphans, search, similarity, textstats, vault
    from vellum.plans import relational
    from vellum.streaming import incremental

    return [orphans, textstats, intel, search, similarity, markdown, vault, html, forms, compose, formats, relational, incremental]


def queries() -> dict[str, Query]:
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in modules() for name, s in m.SQL.items()}
