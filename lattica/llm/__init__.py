"""Operators for large-scale training-data pipelines. Each module holds an operator, its query and, where SQL can say it, its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["licenses", "url_filter", "packing", "language", "sharding", "contamination", "near_dedup", "quality", "tool_calls", "embeddings"]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").ORACLE.items()}
