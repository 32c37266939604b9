"""Scans (A1) and the sales-line CSV reader (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numeric import lenient_int, money_or_zero


def read_table(spark: SparkSession, root: str, name: str, kind: str = "shop") -> DataFrame:
    """Read one table as Parquet with its fixed schema (no inference) (A1).

    ``kind`` picks the schema family: ``"shop"`` for the seven shop tables,
    ``"driver"`` for the benchmark driver's tables.
    """
    struct = (S.SHOP_TABLES if kind == "shop" else S.DRIVER_TABLES).get(name)
    reader = spark.read
    if struct is not None:
        reader = reader.schema(struct)
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the order-line export: header names, every field a string."""
    return (
        spark.read.schema(S.SALES_CSV)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("enforceSchema", False)
        # Like Python's csv module, an empty field is '' and never NULL.
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def type_sales_lines(raw: DataFrame) -> DataFrame:
    """Turn string sales lines into typed ones.

    The export writes 0 and NULL as empty text, so an empty number is 0 (trap
    T5); a line with a number that cannot be read is left to
    :func:`rejected_sales_lines`.  The date key is the first ten characters of
    ``created_at``.
    """
    return raw.where(_unreadable().isNull()).select(
        F.col("order_id"),
        F.col("customer"),
        F.col("email"),
        F.col("status"),
        F.col("created_at"),
        F.col("product"),
        F.col("category"),
        lenient_int(F.col("quantity")).alias("quantity"),
        money_or_zero(F.col("price")).alias("price"),
        money_or_zero(F.col("total_amount")).alias("total_amount"),
    )


def _unreadable():
    """Name of the first number of a line that is neither empty nor readable."""
    numbers = {"quantity": lenient_int, "price": money_or_zero, "total_amount": money_or_zero}
    return F.coalesce(*[
        F.when(parse(F.col(c)).isNull(), F.lit(f"bad_{c}")) for c, parse in numbers.items()])


def rejected_sales_lines(raw: DataFrame) -> DataFrame:
    """Export lines that :func:`type_sales_lines` leaves out, with the reason."""
    return raw.withColumn("reason", _unreadable()).where(F.col("reason").isNotNull())
