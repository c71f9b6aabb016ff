"""Named queries over the test tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL twin where there is one."""

    def put(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return put
