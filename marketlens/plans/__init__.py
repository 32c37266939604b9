"""Registered queries (Spark builder + DuckDB statement) and composed jobs."""

from .registry import REGISTRY, Query, register


def load_all() -> dict[str, Query]:
    """Import every query module so the registry is complete."""
    from . import change_queries, job_queries, sales_queries, shop_queries, stream_queries  # noqa: F401

    return REGISTRY


__all__ = ["REGISTRY", "Query", "register", "load_all"]
