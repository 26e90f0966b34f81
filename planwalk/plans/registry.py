"""Queries by name, each with DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planwalk.plans.oracle import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, or `name`; `views` names the oracle's views that sql builds on, in order.

    A sql text may start with a WITH clause of its own, recursive or not."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            parts = [f"{v} AS ({VIEWS[v]})" for v in views.split()]
            body = sql.strip()
            recursive = body.startswith("WITH RECURSIVE ")
            if body.startswith("WITH "):
                own = body.removeprefix("WITH RECURSIVE " if recursive else "WITH ")
                SQL[key] = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([*parts, own])
            else:
                SQL[key] = f"WITH {', '.join(parts)} {body}" if parts else body
        return f

    return add
