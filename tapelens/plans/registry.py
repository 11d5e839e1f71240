"""Query registry: name -> job over the tables at hand, with SQL to check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapelens.plans import check_sql
from tapelens.plans.market import MarketTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`; `sql` may use any CTE of check_sql."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(MarketTables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tapelens.plans import (  # noqa: F401
        boards_jobs, calibration_jobs, ingest_jobs, policy_jobs, probe_jobs, stream_jobs, text_jobs)
    return dict(QUERIES)


def checks() -> dict[str, str]:
    queries()
    return {name: check_sql.with_ctes(sql) for name, sql in CHECKS.items()}
