"""Operators for training-data pipelines; nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    """Queries of the ten problems, by name."""
    from matchloom.llm.catalog import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict:
    """SQL for those queries that SQL can express over whole tables."""
    from matchloom.llm.oracles import ORACLES

    return dict(ORACLES)
