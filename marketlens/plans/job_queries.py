"""Registered composed jobs (A5 with D13–D17, and the dashboard D1–D8).

Each job's written sections are read back and returned in long form (section,
key, measure, value), so that every figure is compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sales
from ..session import checkpoint_dir
from ..sources.adapter import AS_OF, DriverShop
from . import sales_queries, shop_queries  # noqa: F401  (their statements are used below)
from .jobs import dashboard_job, sales_report_job
from .registry import REGISTRY, register

# section -> (registered query with the same rows, key columns, measures)
REPORT_SECTIONS = {
    "sales_trend": ("line_sales_trend", ["date"], ["orders", "revenue", "units_sold"]),
    "top_products": ("top_products_by_revenue", ["name", "category"], ["units", "revenue"]),
    "category_performance": ("category_performance", ["category"], ["revenue", "units_sold", "order_count"]),
    "customer_segments": ("customer_segments", ["segment", "name", "email"], ["orders", "lifetime_value"]),
    "totals": ("report_totals", [], ["total_revenue", "total_orders", "total_records"]),
}
DASHBOARD_SECTIONS = {
    "top_products": ("top_products_by_views", ["id", "name", "category"],
                     ["views", "price", "total_sold", "revenue"]),
    "sales_by_category": ("sales_by_category", ["category"], ["orders", "units_sold", "revenue"]),
    "sales_trend": ("daily_sales_30d", ["date"], ["orders", "revenue"]),
    "sales_last_7_days": ("daily_sales_7d", ["date"], ["orders", "revenue"]),
    "repeat_customers": ("repeat_customers", ["id", "name", "email"], ["order_count", "lifetime_value"]),
    "page_stats": ("page_stats", ["page"], ["views"]),
    "unique_visitors": ("unique_visitors", [], ["visitors"]),
    "conversion": ("cart_conversion", [], ["cart_additions", "checkouts", "conversion_rate"]),
}


def _out(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def _long_sql(sections) -> str:
    parts = []
    for name, (query, keys, measures) in sections.items():
        key = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")" if keys else "''"
        names = ", ".join(f"'{m}'" for m in measures)
        values = ", ".join(f"CAST({m} AS DOUBLE)" for m in measures)
        parts.append(f"SELECT '{name}' AS section, {key} AS key, unnest([{names}]) AS measure, "
                     f"unnest([{values}]) AS value FROM ({REGISTRY[query].sql})")
    return "\nUNION ALL\n".join(parts)


def _read_long(spark, out, sections):
    frames = []
    for name, (_, keys, measures) in sections.items():
        schema = ", ".join([f"{k} string" for k in keys] + [f"{m} double" for m in measures])
        df = spark.read.schema(schema).json(f"{out}/{name}")
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
        frames.append(df.select(
            F.lit(name).alias("section"), F.concat_ws("|", *keys).alias("key") if keys else F.lit("").alias("key"),
            F.explode(pairs).alias("p")).select("section", "key", "p.measure", "p.value"))
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df)
    return whole


@register("sales_report", "A5 D13 D14 D15 D16 D17", _long_sql(REPORT_SECTIONS))
def q_sales_report(spark, root):
    shop = DriverShop(spark, root)
    out = _out(spark, "sales-report")
    lines = sales.sales_lines(shop.orders, shop.customers, shop.order_items, shop.products())
    sales_report_job(spark, lines, out, generated_at="fixed")
    return _read_long(spark, out, REPORT_SECTIONS)


@register("dashboard", "D1-D8 A5", _long_sql(DASHBOARD_SECTIONS))
def q_dashboard(spark, root):
    shop = DriverShop(spark, root)
    out = _out(spark, "dashboard")
    dashboard_job(spark, shop.products(), shop.order_items, shop.orders, shop.customers, shop.page_views,
                  shop.cart_actions, AS_OF, out)
    return _read_long(spark, out, DASHBOARD_SECTIONS)
