"""Named queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itemrec.runtime import prepare
from itemrec.sources.views import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {
    name: re.sub(r"<epoch\((\w+)\)>", r"cast(floor(epoch(\1)) as bigint)", text)
    .replace("{{", "\0").replace("}}", "\1").replace("{", "").replace("}", "").replace("\0", "{").replace("\1", "}")
    for name, text in VIEWS.items()
}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use any view by name."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(prepare(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sql_view(name: str, text: str) -> None:
    """A building block of comparison SQL."""
    SQL_VIEWS[name] = text


def _words(text: str) -> set[str]:
    return set(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'[^']*'", "", text)))


def expand(sql: str) -> str:
    """``sql`` with the views it needs in front, dependencies first."""
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...] = ()) -> None:
        for name in sorted(_words(text) & set(SQL_VIEWS)):
            if name in path:
                raise ValueError(f"view {name} is used inside itself")
            if name not in ordered:
                visit(SQL_VIEWS[name], (*path, name))
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} as materialized (\n{SQL_VIEWS[n]}\n)" for n in ordered)
    body = sql.strip()
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"
