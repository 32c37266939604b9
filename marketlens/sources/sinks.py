"""File sinks: quoted CSV exports (A3, A4) and the JSON report (A5).

Exports are globally ordered by range-partitioning on the sort key, so the
part files read in sequence are newest first; nothing is gathered on the
driver.  Spark's CSV writer also quotes the header and ends the file with a
newline, where the reference did neither.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _strip_zeros(txt: Column) -> Column:
    """'4500.00' -> '4500', '849.90' -> '849.9' (how JavaScript prints numbers)."""
    return F.regexp_replace(F.regexp_replace(txt, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _js_text(c: Column, dtype: T.DataType) -> Column:
    """``(value || '').toString()``: NULL, 0 and '' become ''; numbers print
    without trailing zeros; timestamps as 'YYYY-MM-DD HH:MM:SS'."""
    if isinstance(dtype, _INTEGRAL + _FRACTIONAL):
        if isinstance(dtype, _INTEGRAL):
            txt = c.cast("string")
        elif isinstance(dtype, T.DecimalType):
            txt = _strip_zeros(c.cast("string"))
        else:
            txt = _strip_zeros(c.try_cast("decimal(38,10)").cast("string"))
        return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(txt)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("true")).otherwise(F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def export_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """The export's text columns, falsy values emptied."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_js_text(F.col(c), types[c]).alias(c) for c in columns])


def write_export(df: DataFrame, path: str, columns: list[str], newest_first_by: str = "created_at",
                 mode: str = "errorifexists") -> None:
    """Write a quoted CSV export, newest first (A3, A4).

    Every value is quoted, a quote inside a value is doubled.  The sort runs
    on the typed column, then the projection to text keeps the order.
    """
    # Ties are broken by the first identifying columns there are: the order is
    # fixed, and rows of one second can be split over range partitions.
    ties = [c for c in ("id", "order_id", "product", "quantity") if c in df.columns]
    ordered = df.orderBy(F.col(newest_first_by).desc_nulls_last(), *[F.col(c).desc() for c in ties])
    (
        export_frame(ordered, columns)
        .write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        # Values are written verbatim; Spark's writer trims by default.
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_sales_export(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The 10-column sales export of C3 lines (A3)."""
    write_export(lines, path, S.SALES_CSV_COLUMNS, mode=mode)


def write_enquiry_export(enquiries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The enquiry export (A4)."""
    write_export(enquiries, path, S.ENQUIRY_CSV_COLUMNS, mode=mode)


def write_report(spark: SparkSession, sections: dict[str, DataFrame], path: str, total_records: DataFrame,
                 generated_at: str | None = None, mode: str = "errorifexists") -> None:
    """JSON report: one JSON-lines dataset per section plus a one-row summary (A5).

    Segment lists grow with the customers, so the report is never built as
    one driver-side document.
    """
    stamp = generated_at or dt.datetime.now(dt.timezone.utc).isoformat()
    summary = total_records.select(F.lit(stamp).alias("generated_at"), F.col("total_records"))
    summary.coalesce(1).write.mode(mode).json(f"{path}/summary")
    for name, df in sections.items():
        df.write.mode(mode).json(f"{path}/{name}")
