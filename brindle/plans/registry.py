"""The registered queries of the engine, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``; ``sql`` gives the same rows in DuckDB."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep
