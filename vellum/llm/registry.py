"""The queries of the training-data operators and their SQL."""

from __future__ import annotations


def modules() -> list:
    from vellum.llm import knn, leak, level, mainbody, neardup, packing, quality, split, tokens

    return [split, level, mainbody, neardup, knn, tokens, packing, leak, quality]


def queries() -> dict:
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in modules() for name, s in m.SQL.items()}
