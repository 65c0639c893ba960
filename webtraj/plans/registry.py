"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; without SQL only tests check it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load():
    from . import queries_actions, queries_curation, queries_diagnosis, queries_pages, queries_runs, queries_sources, queries_streams  # noqa: F401

    return QUERIES, ORACLE
