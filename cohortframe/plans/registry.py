"""Named queries with, where plain SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortframe.plans.fixtures import SQL_VIEWS, Data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def compose(body: str) -> str:
    """Put the shared views that a statement uses, and those they use, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    views = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    body = body.strip()
    if not views:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[Data], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: function(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return function

    return register
