"""Bounded training samples and shared helpers of the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def bounded_sample(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of ``key``.

    Only a hash range that holds about twice as many rows is sorted, so what
    tasks send for the sort is bounded however many tasks there are.
    """
    cells = 1 << 30
    share = min(cells, 2 * limit * cells // max(1, rows.count()) + 1)
    near = rows.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(cells)) < share)
    return near.orderBy(F.xxhash64(key), key).limit(limit)
