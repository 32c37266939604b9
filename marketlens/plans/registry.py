"""Registry of named queries: a Spark builder and, where SQL can state it, a
DuckDB statement over the same driver tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str  # operator ids from the survey this query covers


REGISTRY: dict[str, Query] = {}


def prepare_session(spark: SparkSession) -> None:
    """Settings the results depend on, applied to a caller's session.

    Day windows and date keys are defined in UTC; everything else (AQE,
    thresholds, partitions) is left to the session's owner.
    """
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(name: str, ids: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = Query(name, build, sql, ids)
        return fn

    return wrap
