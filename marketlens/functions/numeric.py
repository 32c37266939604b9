"""Numeric, null and parsing helpers (H11–H16) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONEY

_INT_PREFIX = r"^[\s]*([+-]?[0-9]+)"
_FLOAT_PREFIX = r"^[\s]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def zero_if_null(c: Column) -> Column:
    """``COALESCE(x, 0)``."""
    return F.coalesce(c, F.lit(0))


def js_or(c: Column, default, text: bool = False) -> Column:
    """JavaScript ``x || d``: 0, '' and NULL all take the default."""
    falsy = F.lit("") if text else F.lit(0)
    return F.coalesce(F.nullif(c, falsy), default if isinstance(default, Column) else F.lit(default))


def parse_int_js(c: Column) -> Column:
    """``parseInt``: leading digits after blanks, else NULL (NaN)."""
    digits = F.regexp_extract(c.cast("string"), _INT_PREFIX, 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def parse_float_js(c: Column) -> Column:
    """``parseFloat``: leading decimal number, else NULL (NaN)."""
    num = F.regexp_extract(c.cast("string"), _FLOAT_PREFIX, 1)
    return F.nullif(num, F.lit("")).try_cast("double")


def lenient_int(c: Column) -> Column:
    """Python ``int(x or 0)`` over CSV text: empty counts as 0, and text that is
    no number is NULL, for the caller to reject (H14, T5)."""
    return F.when(is_blank(c), F.lit(0)).otherwise(F.trim(c).try_cast("bigint"))


def money_or_zero(c: Column) -> Column:
    """Python ``float(x or 0)`` for money, kept as decimal: empty counts as 0,
    text that is no amount is NULL (H14, T5)."""
    return F.when(is_blank(c), F.lit(0).cast(MONEY)).otherwise(F.trim(c).try_cast(MONEY))


def is_blank(c: Column) -> Column:
    """NULL or only blanks."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def money(c: Column) -> Column:
    """Cast a column to the money type."""
    return c.cast(MONEY)


def as_double(c: Column) -> Column:
    """Leave the exact decimal domain at the output edge."""
    return c.cast("double")


def clamp_to_stock(quantity: Column, stock: Column) -> Column:
    """``Math.min(quantity, stock)`` that stays NULL when either side is."""
    return F.when(quantity.isNull() | stock.isNull(), F.lit(None)).otherwise(F.least(quantity, stock))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part / whole * 100`` rounded half-up in decimal; 0 when ``whole`` is 0."""
    ratio = F.try_divide(part.cast("decimal(38,6)") * F.lit(100), whole.cast("decimal(38,6)"))
    return F.coalesce(F.round(ratio, digits), F.lit(0)).cast("double")


def cents_of(df, money_col: str) -> Column:
    """Whole cents (bigint) of a money column, for fast exact sums.

    Uses ``<col>_cents`` when the frame carries it (computed once from the
    source), else multiplies the decimal.  A bigint sum of cents is exact and
    about twice as fast as a decimal sum; under ANSI mode an overflow raises
    instead of wrapping (headroom: 9.2e16 currency units per group).
    """
    if f"{money_col}_cents" in df.columns:
        return F.col(f"{money_col}_cents")
    return (F.col(money_col) * F.lit(100)).cast("bigint")


def source_cents(c: Column) -> Column:
    """Cents of a double money value that has at most two decimals."""
    return F.round(c * F.lit(100)).cast("bigint")


def cents_to_money(c: Column) -> Column:
    """Exact decimal from a (possibly large) sum of cents."""
    return (c.cast("decimal(38,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(38,2)")
