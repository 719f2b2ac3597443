"""The queries of this folder; importing it registers them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with its SQL if it has one."""

    def keep(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


for _name in ("queries",):
    importlib.import_module(f"duskwatch.llm.{_name}")
