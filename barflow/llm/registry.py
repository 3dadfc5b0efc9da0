"""Queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ("fingerprints", "secrets", "bpe", "simhash", "sharding", "quality", "rules", "mixing", "substrings", "language", "records", "manifest", "phrases")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"barflow.llm.{name}")
