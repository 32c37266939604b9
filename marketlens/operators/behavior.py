"""Behaviour operators over the page-view and cart-action logs.

The capture functions (J1, J2) are plain projections and filters, so the
same code runs on a batch DataFrame and on a streaming one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_blank, js_or, parse_int_js, percent
from ..functions.text import API_PREFIX, PRODUCT_PATH, is_page_request, product_id_from_path

# The allowed cart actions.
CART_ACTIONS = ["add", "remove", "checkout"]


def page_stats(views: DataFrame, k: int = 10) -> DataFrame:
    """Views per page, top k."""
    return (
        views.groupBy("page")
        .agg(F.count(F.lit(1)).alias("views"))
        .orderBy(F.col("views").desc(), F.col("page").asc())
        .limit(k)
    )


def unique_visitors(views: DataFrame) -> DataFrame:
    """``COUNT(DISTINCT session_id)``; NULL sessions are not counted."""
    return views.agg(F.count_distinct("session_id").alias("visitors"))


def cart_conversion(cart: DataFrame) -> DataFrame:
    """Checkout rows / add rows × 100, one decimal, 0 without adds.

    Counts rows, not sessions, so the rate may exceed 100.  One scan with
    two conditional counts.
    """
    counts = cart.agg(
        F.count_if(F.col("action") == "add").alias("cart_additions"),
        F.count_if(F.col("action") == "checkout").alias("checkouts"),
    )
    return counts.select(
        "cart_additions", "checkouts",
        percent(F.col("checkouts"), F.col("cart_additions"), 1).alias("conversion_rate"),
    )


def page_view_rows(requests: DataFrame, id_pattern: str = PRODUCT_PATH,
                   api_prefix: str = API_PREFIX) -> DataFrame:
    """Request log -> page-view rows.

    Keeps GET requests outside the API prefix whose path has no '.', and
    derives the product id from the path; anonymous users stay NULL.
    """
    return requests.where(is_page_request(F.col("method"), F.col("path"), api_prefix)).select(
        F.col("session_id"),
        F.col("user_id"),
        F.col("path").alias("page"),
        product_id_from_path(F.col("path"), id_pattern).alias("product_id"),
        F.col("ts").alias("created_at"),
    )


def cart_action_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracked cart actions -> (accepted rows, rejected rows with a reason).

    ``productId`` and ``action`` are required; the product id is parsed like
    ``parseInt``; the quantity defaults to 1 when missing or 0 and is refused
    when it is no number; an action outside the allowed set is refused as the
    table's CHECK would.
    """
    pid = parse_int_js(F.col("productId"))
    action_text = F.col("action").cast("string")
    quantity = F.col("quantity").cast("string")
    reason = (
        F.when(js_or(F.col("productId").cast("string"), None, text=True).isNull()
               | js_or(action_text, None, text=True).isNull(), F.lit("missing_fields"))
        .when(pid.isNull(), F.lit("bad_product_id"))
        .when(~action_text.isin(*CART_ACTIONS), F.lit("action_not_allowed"))
        .when(~is_blank(quantity) & quantity.try_cast("int").isNull(), F.lit("bad_quantity"))
    )
    tagged = raw.withColumn("reason", reason)
    accepted = tagged.where(F.col("reason").isNull()).select(
        "session_id", "user_id",
        pid.alias("product_id"),
        action_text.alias("action"),
        js_or(quantity.try_cast("int"), 1).alias("quantity"),
        F.col("ts").alias("created_at"),
    )
    rejected = tagged.where(F.col("reason").isNotNull())
    return accepted, rejected
