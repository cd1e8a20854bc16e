"""Operators for large-scale training data; nothing else in the package imports them."""

from __future__ import annotations


def queries() -> dict:
    from textloom.llm import registry

    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    from textloom.llm import registry

    return dict(registry.ORACLE)
