"""Registered queries and their SQL equivalents."""

from __future__ import annotations


def modules() -> list:
    """The query modules of the core."""
    from . import accounts, analytics, catalog, formulas, more, performance, pipelines, tables, training

    return [accounts, training, formulas, analytics, tables, performance, more, pipelines, catalog]
