"""Registered sales queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sales
from ..session import materialize
from ..sources.adapter import AS_OF, DriverShop
from .oracle import with_ctes
from .registry import register


def _lines(shop: DriverShop):
    return sales.sales_lines(shop.orders, shop.customers, shop.order_items, shop.products())


@register("sales_by_category", "D2", with_ctes("""
    SELECT p.category, COUNT(i.order_id) AS orders,
           CAST(SUM(i.quantity) AS BIGINT) AS units_sold,
           CAST(SUM(i.line_total) AS DOUBLE) AS revenue
    FROM s_items i JOIN s_products p ON i.product_id = p.id
    GROUP BY p.category""", "s_items", "s_products"))
def q_sales_by_category(spark, root):
    shop = DriverShop(spark, root)
    return sales.sales_by_category(shop.order_items, shop.products())


@register("top_products_by_views", "D1 C6 F1 H11", with_ctes("""
    SELECT p.id, p.name, p.category, p.views, CAST(p.price AS DOUBLE) AS price,
           COUNT(i.order_id) AS total_sold,
           CAST(COALESCE(SUM(i.line_total), 0) AS DOUBLE) AS revenue
    FROM (SELECT * FROM s_products ORDER BY views DESC, id ASC LIMIT 10) p
    LEFT JOIN s_items i ON p.id = i.product_id
    GROUP BY p.id, p.name, p.category, p.views, p.price""", "s_products", "s_items"))
def q_top_products_by_views(spark, root):
    shop = DriverShop(spark, root)
    return sales.top_products_by_views(shop.products(), shop.order_items, k=10)


_DAILY_SQL = """
    SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS orders,
           CAST(SUM(total_amount) AS DOUBLE) AS revenue
    FROM s_orders
    WHERE created_at >= CAST(DATE '{as_of}' - INTERVAL {days} DAY AS TIMESTAMP)
      AND status != 'cancelled'
    GROUP BY 1"""


@register("daily_sales_30d", "D3 B6 B7 H7", with_ctes(_DAILY_SQL.format(as_of=AS_OF, days=30), "s_orders"))
def q_daily_sales_30d(spark, root):
    return sales.daily_sales(DriverShop(spark, root).orders, 30, AS_OF)


@register("daily_sales_7d", "D4 B6 B7 H7", with_ctes(_DAILY_SQL.format(as_of=AS_OF, days=7), "s_orders"))
def q_daily_sales_7d(spark, root):
    return sales.daily_sales(DriverShop(spark, root).orders, 7, AS_OF)


@register("sales_lines", "C3", with_ctes("""
    SELECT order_id, customer, email, CAST(total_amount AS DOUBLE) AS total_amount, status,
           created_at, product, category, quantity, CAST(price AS DOUBLE) AS price
    FROM s_lines""", "s_lines"))
def q_sales_lines(spark, root):
    lines = _lines(DriverShop(spark, root))
    return lines.select(
        "order_id", "customer", "email", F.col("total_amount").cast("double").alias("total_amount"),
        "status", "created_at", "product", "category", "quantity",
        F.col("price").cast("double").alias("price"),
    )


@register("order_product_names", "C5 D12 H6", with_ctes("""
    SELECT o.id, o.customer_id, CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
           o.created_at,
           string_agg(p.name, ', ' ORDER BY p.name) AS product_names
    FROM s_orders o
    LEFT JOIN s_items i ON o.id = i.order_id
    LEFT JOIN s_products p ON i.product_id = p.id
    GROUP BY o.id, o.customer_id, o.total_amount, o.status, o.created_at""",
    "s_orders", "s_items", "s_products"))
def q_order_product_names(spark, root):
    shop = DriverShop(spark, root)
    return sales.order_product_names(shop.orders, shop.order_items, shop.products())


@register("restock_units", "D21", with_ctes("""
    SELECT i.product_id, CAST(SUM(i.quantity) AS BIGINT) AS units
    FROM s_items i WHERE i.order_id IN (SELECT id FROM s_orders WHERE status = 'cancelled')
    GROUP BY i.product_id""", "s_items", "s_orders"))
def q_restock_units(spark, root):
    shop = DriverShop(spark, root)
    cancelled = shop.orders.where(F.col("status") == "cancelled")
    return sales.restock_units(cancelled, shop.order_items)


@register("line_sales_trend", "D13 H8", with_ctes("""
    SELECT substr(CAST(created_at AS VARCHAR), 1, 10) AS date,
           COUNT(DISTINCT order_id) AS orders,
           CAST(ROUND(SUM(line_total), 2) AS DOUBLE) AS revenue,
           CAST(SUM(quantity) AS BIGINT) AS units_sold
    FROM s_lines GROUP BY 1""", "s_lines"))
def q_line_sales_trend(spark, root):
    return sales.line_sales_trend(_lines(DriverShop(spark, root)))


@register("trend_last_days", "D13 F4", with_ctes("""
    SELECT substr(CAST(created_at AS VARCHAR), 1, 10) AS date,
           COUNT(DISTINCT order_id) AS orders,
           CAST(ROUND(SUM(line_total), 2) AS DOUBLE) AS revenue,
           CAST(SUM(quantity) AS BIGINT) AS units_sold
    FROM s_lines GROUP BY 1 ORDER BY 1 DESC LIMIT 7""", "s_lines"))
def q_trend_last_days(spark, root):
    return sales.last_days(sales.line_sales_trend(_lines(DriverShop(spark, root))), 7)


@register("top_five_products", "D15 F4", with_ctes("""
    SELECT name, category, units, CAST(ROUND(rev, 2) AS DOUBLE) AS revenue FROM (
      SELECT product AS name, MAX(category) AS category,
             CAST(SUM(quantity) AS BIGINT) AS units, SUM(line_total) AS rev
      FROM s_lines GROUP BY product ORDER BY rev DESC, name ASC LIMIT 5)""", "s_lines"))
def q_top_five_products(spark, root):
    return sales.top_products_by_revenue(_lines(DriverShop(spark, root)), k=5)


_SEGMENT_SQL = """
    SELECT CASE WHEN n >= 5 AND rev >= 10000 THEN 'champions'
                WHEN n >= 3 THEN 'loyal' WHEN n >= 2 THEN 'at_risk' ELSE 'new' END AS segment,
           name, email, n AS orders, CAST(ROUND(rev, 2) AS DOUBLE) AS lifetime_value
    FROM (SELECT email, MAX(customer) AS name, COUNT(*) AS n, SUM(line_total) AS rev
          FROM s_lines WHERE email IS NOT NULL AND email != '' GROUP BY email)"""


@register("customer_segments", "D14", with_ctes(_SEGMENT_SQL, "s_lines"))
def q_customer_segments(spark, root):
    return sales.customer_segments(_lines(DriverShop(spark, root)))


@register("segment_counts", "D18", with_ctes(f"""
    SELECT l.segment, COALESCE(c.customers, 0) AS customers
    FROM (VALUES ('champions'), ('loyal'), ('at_risk'), ('new')) AS l(segment)
    LEFT JOIN (SELECT segment, COUNT(*) AS customers FROM ({_SEGMENT_SQL}) GROUP BY segment) c
      ON c.segment = l.segment""", "s_lines"))
def q_segment_counts(spark, root):
    return sales.segment_counts(sales.customer_segments(_lines(DriverShop(spark, root))))


@register("top_products_by_revenue", "D15 F4", with_ctes("""
    SELECT name, category, units, CAST(ROUND(rev, 2) AS DOUBLE) AS revenue FROM (
      SELECT product AS name, MAX(category) AS category,
             CAST(SUM(quantity) AS BIGINT) AS units, SUM(line_total) AS rev
      FROM s_lines GROUP BY product ORDER BY rev DESC, name ASC LIMIT 10)""", "s_lines"))
def q_top_products_by_revenue(spark, root):
    return sales.top_products_by_revenue(_lines(DriverShop(spark, root)), k=10)


_CATEGORY_PERF_SQL = """
    SELECT category, CAST(ROUND(SUM(line_total), 2) AS DOUBLE) AS revenue,
           CAST(SUM(quantity) AS BIGINT) AS units_sold,
           COUNT(DISTINCT order_id) AS order_count
    FROM s_lines GROUP BY category"""


@register("category_performance", "D16", with_ctes(_CATEGORY_PERF_SQL, "s_lines"))
def q_category_performance(spark, root):
    return sales.category_performance(_lines(DriverShop(spark, root)))


@register("report_totals", "D17", with_ctes(f"""
    SELECT (SELECT CAST(SUM(CAST(revenue AS DECIMAL(38,2))) AS DOUBLE) FROM ({_CATEGORY_PERF_SQL})) AS total_revenue,
           (SELECT CAST(SUM(orders) AS BIGINT) FROM (
               SELECT COUNT(DISTINCT order_id) AS orders FROM s_lines
               GROUP BY substr(CAST(created_at AS VARCHAR), 1, 10))) AS total_orders,
           (SELECT COUNT(*) FROM s_lines) AS total_records""", "s_lines"))
def q_report_totals(spark, root):
    # Written once: the three totals share one run of the join.
    columns = ["order_id", "created_at", "category", "quantity", "line_total_cents"]
    lines = materialize(_lines(DriverShop(spark, root)).select(*columns), "report-lines")
    return sales.report_totals(sales.line_sales_trend(lines), sales.category_performance(lines), lines)


@register("category_share", "E1 E2", with_ctes("""
    SELECT category, orders, units_sold, revenue,
           CAST(COALESCE(ROUND(CAST(revenue AS DECIMAL(38,2)) * 100
                 / NULLIF(SUM(CAST(revenue AS DECIMAL(38,2))) OVER (), 0), 1), 0) AS DOUBLE) AS share_pct,
           CAST(COALESCE(ROUND(CAST(revenue AS DECIMAL(38,2)) * 100
                 / NULLIF(MAX(CAST(revenue AS DECIMAL(38,2))) OVER (), 0), 1), 0) AS DOUBLE) AS of_max_pct
    FROM (SELECT p.category, COUNT(i.order_id) AS orders,
                 CAST(SUM(i.quantity) AS BIGINT) AS units_sold,
                 CAST(SUM(i.line_total) AS DOUBLE) AS revenue
          FROM s_items i JOIN s_products p ON i.product_id = p.id
          GROUP BY p.category)""", "s_items", "s_products"))
def q_category_share(spark, root):
    shop = DriverShop(spark, root)
    return sales.with_shares(sales.sales_by_category(shop.order_items, shop.products()), "revenue")


@register("weekly_sales_trend", "2.12 weekly", with_ctes("""
    SELECT CAST(date_trunc('week', CAST(substr(CAST(created_at AS VARCHAR), 1, 10) AS TIMESTAMP)) AS DATE) AS week,
           COUNT(DISTINCT order_id) AS orders,
           CAST(ROUND(SUM(line_total), 2) AS DOUBLE) AS revenue,
           CAST(SUM(quantity) AS BIGINT) AS units_sold
    FROM s_lines GROUP BY 1""", "s_lines"))
def q_weekly_sales_trend(spark, root):
    return sales.weekly_sales_trend(_lines(DriverShop(spark, root)))


@register("artisan_sales", "2.12 artisans", with_ctes("""
    SELECT a.id AS artisan_id, a.name AS artisan_name, COUNT(i.order_id) AS lines,
           CAST(SUM(i.quantity) AS BIGINT) AS units_sold,
           CAST(SUM(i.line_total) AS DOUBLE) AS revenue
    FROM s_items i JOIN s_products_owned p ON i.product_id = p.id
    JOIN s_artisans a ON a.id = p.artisan_id
    GROUP BY a.id, a.name""", "s_items", "s_products_owned", "s_artisans"))
def q_artisan_sales(spark, root):
    shop = DriverShop(spark, root)
    return sales.artisan_sales(shop.order_items, shop.owned_products(), shop.artisans)
