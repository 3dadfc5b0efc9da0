"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, tuple[str, tuple[str, ...]]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
#: Of single queries: CTEs that replace the shared ones of the same name.
OWN: dict[str, dict[str, tuple[tuple[str, ...], str]]] = {}


def cte(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    if name in CTES:
        raise ValueError(f"CTE {name!r} is defined twice")
    CTES[name] = (uses, sql)


def _needed(names, seen: list[str], ctes) -> list[str]:
    for n in names:
        if n not in seen:
            _needed(ctes[n][0], seen, ctes)
            if n not in seen:
                seen.append(n)
    return seen


def sql_text(body: str, uses=(), own=None) -> str:
    ctes = CTES | (own or {})
    parts = [f"{n} AS {ctes[n][1]}" if ctes[n][1].startswith("(") else f"{n} AS MATERIALIZED ({ctes[n][1]})" for n in _needed(uses, [], ctes)]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), own=None):
    """Register a query; ``sql`` is its oracle body, ``uses`` the shared CTEs it reads, ``own`` replaces some of them."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = (sql, uses)
            OWN[name] = own or {}
        return fn

    return register
