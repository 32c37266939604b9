"""Registry of the subpackage's queries: builder and optional DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("language_id", "byte_bpe", "decontamination", "toxicity", "chat_format", "quality", "url_filter", "ngram_jaccard", "pii",
           "fingerprint", "periodic_runs", "prefix_trie", "site_template")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return wrap


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_all() -> tuple[dict, dict]:
    """Import every operator module; return (queries, oracle SQL)."""
    for module in MODULES:
        importlib.import_module(f"marketlens.llm.{module}")
    return QUERIES, ORACLE_SQL
