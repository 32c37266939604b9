"""Composed jobs: the offline sales report and the dashboard, end to end.

The report computes the order lines once, writes them to the shared
checkpoint folder and derives every section from that one table.  The
dashboard's figures read different tables, each with its own pruned scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behavior, customers, sales
from ..session import materialize
from ..sources.sinks import write_report


REPORT_COLUMNS = ["order_id", "customer", "email", "created_at", "product", "category", "quantity"]


def sales_report_job(spark: SparkSession, lines: DataFrame, out_dir: str,
                     generated_at: str | None = None) -> dict[str, DataFrame]:
    """The report of the offline script (D13–D17, A5) over one materialised
    copy of the sales lines; returns the written sections."""
    # Only the columns the sections read are stored: the cents of a line's
    # total when the lines carry them, else its unit price and total.
    money_cols = ["line_total_cents"] if "line_total_cents" in lines.columns else ["price", "line_total"]
    keep = [c for c in REPORT_COLUMNS + money_cols if c in lines.columns]
    stored = materialize(lines.select(*keep), "sales-lines")
    sections = {
        "sales_trend": sales.line_sales_trend(stored),
        "top_products": sales.top_products_by_revenue(stored),
        "category_performance": sales.category_performance(stored),
        "customer_segments": sales.customer_segments(stored),
    }
    sections["totals"] = sales.report_totals(sections["sales_trend"], sections["category_performance"], stored)
    write_report(spark, sections, out_dir, stored.agg(F.count(F.lit(1)).alias("total_records")),
                 generated_at=generated_at)
    return sections


def dashboard_job(spark: SparkSession, products: DataFrame, items: DataFrame, orders: DataFrame,
                  users: DataFrame, views: DataFrame, cart: DataFrame, as_of: str,
                  out_dir: str) -> None:
    """The admin dashboard (D1–D8) written as one JSON dataset per figure."""
    parts = {
        "top_products": sales.top_products_by_views(products, items),
        "sales_by_category": sales.sales_by_category(items, products),
        "sales_trend": sales.daily_sales(orders, 30, as_of),
        "sales_last_7_days": sales.daily_sales(orders, 7, as_of),
        "repeat_customers": customers.repeat_customers(orders, users),
        "page_stats": behavior.page_stats(views),
        "unique_visitors": behavior.unique_visitors(views),
        "conversion": behavior.cart_conversion(cart),
    }
    for name, df in parts.items():
        df.write.mode("errorifexists").json(f"{out_dir}/{name}")
