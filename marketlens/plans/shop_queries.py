"""Registered catalogue, customer and behaviour queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import (ENQUIRY_TEXT_MAX, PRODUCT_TEXT_MAX, USER_TEXT_MAX, city, email_ok,
                              first_at_token, sanitize)
from ..operators import behavior, catalog, customers, search
from ..session import checkpoint_dir
from ..sources.adapter import DriverShop
from .oracle import sql_email_ok, sql_sanitize, with_ctes
from .registry import register

# Parameters of the registered catalogue pages.
PAGE_CATEGORY = "PROMO"
SEARCH_TEXT = "Ring"
DEEP_OFFSET = 40
# Product ids in the driver's page URLs look like /en/825.
DRIVER_ID_PATTERN = "/[a-z]{2}/([0-9]+)"

_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CATALOG_SELECT = """
    SELECT p.id, p.name, p.description, CAST(p.price AS DOUBLE) AS price,
           CAST(p.bulk_price AS DOUBLE) AS bulk_price, p.min_bulk_qty, p.category,
           p.artisan_id, p.stock, p.views, a.name AS artisan_name, a.address AS artisan_location
    FROM s_products_owned p JOIN s_artisans a ON a.id = p.artisan_id"""


def _owned(shop: DriverShop):
    return shop.owned_products()


# --- catalogue ----------------------------------------------------------------

@register("catalog_page", "B1 F2 C1", with_ctes(
    _CATALOG_SELECT + f"""
    WHERE p.category = '{PAGE_CATEGORY}'
    ORDER BY p.views DESC, p.id ASC LIMIT 20""", "s_products_owned", "s_artisans"))
def q_catalog_page(spark, root):
    shop = DriverShop(spark, root)
    return catalog.catalog_page(_owned(shop), shop.artisans, category=PAGE_CATEGORY)


@register("catalog_page_deep", "B1 F2", with_ctes(
    _CATALOG_SELECT + f"""
    ORDER BY p.views DESC, p.id ASC LIMIT 20 OFFSET {DEEP_OFFSET}""", "s_products_owned", "s_artisans"))
def q_catalog_page_deep(spark, root):
    shop = DriverShop(spark, root)
    return catalog.catalog_page(_owned(shop), shop.artisans, offset=DEEP_OFFSET)


_RANKED_PAGES = """, listing AS (
    SELECT row_number() OVER (ORDER BY views DESC, id ASC) - 1 AS rank, * FROM (""" + _CATALOG_SELECT + """))
"""


@register("catalog_page_keys", "B1 F2", with_ctes(_RANKED_PAGES + """
    SELECT CAST(rank // 20 AS BIGINT) AS page, views, id FROM listing WHERE rank % 20 = 0""",
    "s_products_owned", "s_artisans"))
def q_catalog_page_keys(spark, root):
    shop = DriverShop(spark, root)
    return catalog.PageDirectory(_owned(shop), shop.artisans).start_keys()


@register("catalog_page_last", "B1 F2", with_ctes(_RANKED_PAGES + """
    SELECT * EXCLUDE (rank) FROM listing WHERE rank // 20 = (SELECT MAX(rank) // 20 FROM listing)""",
    "s_products_owned", "s_artisans"))
def q_catalog_page_last(spark, root):
    shop = DriverShop(spark, root)
    directory = catalog.PageDirectory(_owned(shop), shop.artisans)
    return directory.page(max(directory.pages - 1, 0))


@register("catalog_page_keyset", "B1 F2", with_ctes(
    _CATALOG_SELECT + f"""
    ORDER BY p.views DESC, p.id ASC LIMIT 20 OFFSET {DEEP_OFFSET}""", "s_products_owned", "s_artisans"))
def q_catalog_page_keyset(spark, root):
    """The page that follows the last row shown, found by its key."""
    shop = DriverShop(spark, root)
    shown = catalog.catalog_page(_owned(shop), shop.artisans, limit=1, offset=DEEP_OFFSET - 1).first()
    if shown is None:  # fewer rows than the pages before
        return catalog.catalog_page(_owned(shop), shop.artisans, offset=DEEP_OFFSET)
    return catalog.catalog_page_after(_owned(shop), shop.artisans, shown["views"], shown["id"])


_needle = SEARCH_TEXT.lower()


@register("catalog_search", "B2 H1 H5", with_ctes(
    _CATALOG_SELECT + f"""
    WHERE COALESCE({_LOWER.format(c='p.name')} LIKE '%{_needle}%' ESCAPE '!', FALSE)
       OR COALESCE({_LOWER.format(c='p.description')} LIKE '%{_needle}%' ESCAPE '!', FALSE)
    ORDER BY p.views DESC, p.id ASC LIMIT 20""", "s_products_owned", "s_artisans"))
def q_catalog_search(spark, root):
    shop = DriverShop(spark, root)
    return catalog.catalog_page(_owned(shop), shop.artisans, search=SEARCH_TEXT)


@register("catalog_search_indexed", "B2 H1 H5", with_ctes(
    _CATALOG_SELECT + f"""
    WHERE COALESCE({_LOWER.format(c='p.name')} LIKE '%{_needle}%' ESCAPE '!', FALSE)
       OR COALESCE({_LOWER.format(c='p.description')} LIKE '%{_needle}%' ESCAPE '!', FALSE)""",
    "s_products_owned", "s_artisans"))
def q_catalog_search_indexed(spark, root):
    """Every match of a search, by stored trigrams."""
    shop = DriverShop(spark, root)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/search/{uuid.uuid4().hex}"
    search.write_postings(_owned(shop), folder)
    found = search.search_products(_owned(shop), search.read_postings(spark, folder), SEARCH_TEXT)
    return catalog._catalog_columns(catalog.with_artisan(found, shop.artisans))


@register("artisan_products", "B9", with_ctes("""
    SELECT id, name, category, stock, created_at, artisan_id AS viewer_id FROM s_products_owned
    WHERE artisan_id IN (SELECT id FROM s_artisans)""", "s_products_owned", "s_artisans"))
def q_artisan_products(spark, root):
    shop = DriverShop(spark, root)
    principals = shop.artisans.select(F.col("id").alias("user_id"), "role")
    return catalog.own_products(_owned(shop), principals).select(
        "id", "name", "category", "stock", "created_at", "viewer_id")


_ADMIN_PRODUCTS = """
    SELECT p.id, p.name, p.category, p.stock, p.created_at, a.name AS artisan_name
    FROM s_products_owned p JOIN s_artisans a ON a.id = p.artisan_id"""


@register("admin_products", "B9", with_ctes(_ADMIN_PRODUCTS, "s_products_owned", "s_artisans"))
def q_admin_products(spark, root):
    shop = DriverShop(spark, root)
    return catalog.all_products(_owned(shop), shop.artisans).select(
        "id", "name", "category", "stock", "created_at", "artisan_name")


@register("admin_products_newest", "B9 F5", with_ctes(
    _ADMIN_PRODUCTS + "\n    ORDER BY p.created_at DESC, p.id DESC LIMIT 50", "s_products_owned", "s_artisans"))
def q_admin_products_newest(spark, root):
    """The first screen of the list: its order decides which rows these are."""
    return q_admin_products(spark, root).limit(50)


@register("products_by_city", "H9 C1", with_ctes("""
    SELECT split_part(concat_ws(', ', a.address, a.role), ',', 1) AS city, COUNT(*) AS products
    FROM s_products_owned p JOIN s_artisans a ON a.id = p.artisan_id GROUP BY 1""",
    "s_products_owned", "s_artisans"))
def q_products_by_city(spark, root):
    """Products per city: the part of the artisan's address before the first comma."""
    shop = DriverShop(spark, root)
    artisans = shop.artisans.withColumn("address", F.concat_ws(", ", "address", "role"))
    located = catalog.with_artisan(_owned(shop), artisans)
    return located.groupBy(city(F.col("artisan_location")).alias("city")).agg(F.count(F.lit(1)).alias("products"))


@register("catalog_total", "D11", "SELECT COUNT(*) AS total FROM part")
def q_catalog_total(spark, root):
    return catalog.catalog_total(DriverShop(spark, root).products())


@register("category_menu", "D10 G1 G2", with_ctes("""
    SELECT 'All' AS category, 0 AS sort_key
    UNION ALL SELECT DISTINCT category, 1 AS sort_key FROM s_products""", "s_products"))
def q_category_menu(spark, root):
    return catalog.category_menu(DriverShop(spark, root).products())


@register("products_with_artisan", "C1", with_ctes(_CATALOG_SELECT, "s_products_owned", "s_artisans"))
def q_products_with_artisan(spark, root):
    shop = DriverShop(spark, root)
    return catalog._catalog_columns(catalog.with_artisan(_owned(shop), shop.artisans))


@register("product_detail", "B3", with_ctes("""
    SELECT p.id, p.name, p.description, CAST(p.price AS DOUBLE) AS price, p.category, p.stock,
           p.views, p.artisan_id, a.name AS artisan_name, a.address AS artisan_location,
           a.phone AS artisan_phone
    FROM s_products_owned p JOIN s_artisans a ON a.id = p.artisan_id
    WHERE p.id IN (SELECT product_id FROM s_page_views)""",
    "s_products_owned", "s_artisans", "s_page_views"))
def q_product_detail(spark, root):
    shop = DriverShop(spark, root)
    ids = shop.page_views.select(F.col("product_id").alias("id"))
    return catalog.product_detail(_owned(shop), shop.artisans, ids)


@register("order_detail", "C4", with_ctes("""
    SELECT i.order_id, i.product_id, i.quantity, CAST(i.price AS DOUBLE) AS price, p.name, p.image_url,
           a.name AS artisan_name
    FROM s_items i JOIN s_products_owned p ON p.id = i.product_id
    JOIN s_artisans a ON a.id = p.artisan_id
    WHERE i.order_id IN (SELECT id FROM s_orders)""",
    "s_items", "s_products_owned", "s_artisans", "s_orders"))
def q_order_detail(spark, root):
    shop = DriverShop(spark, root)
    return catalog.order_detail(shop.orders, shop.order_items, _owned(shop), shop.artisans)


@register("related_products", "C7 E3 F3", with_ctes("""
    SELECT product_id, related_id, CAST(position AS INTEGER) AS position FROM (
      SELECT a.id AS product_id, b.id AS related_id,
             ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY b.id) AS position
      FROM s_products a JOIN s_products b ON a.category = b.category AND a.id != b.id)
    WHERE position <= 4""", "s_products"))
def q_related_products(spark, root):
    return catalog.related_products(DriverShop(spark, root).products(), k=4)


@register("bulk_offers", "B8", with_ctes("""
    SELECT id, name, CAST(price AS DOUBLE) AS price,
           COALESCE(bulk_price, 0) != 0 AS has_bulk_offer,
           CAST(CASE WHEN COALESCE(bulk_price, 0) != 0 THEN bulk_price END AS DOUBLE) AS bulk_price,
           CASE WHEN COALESCE(bulk_price, 0) != 0 THEN min_bulk_qty END AS min_bulk_qty
    FROM s_products""", "s_products"))
def q_bulk_offers(spark, root):
    return catalog.bulk_offers(DriverShop(spark, root).products())


# --- customers ------------------------------------------------------------------

@register("user_directory", "B4", with_ctes("""
    SELECT id, name, email, role, phone, address, CAST(NULL AS TIMESTAMP) AS created_at
    FROM (SELECT * FROM s_customers UNION ALL SELECT * FROM s_artisans)""", "s_customers", "s_artisans"))
def q_user_directory(spark, root):
    shop = DriverShop(spark, root)
    return customers.user_directory(shop.customers.unionByName(shop.artisans))


@register("orders_with_customer", "C2", with_ctes("""
    SELECT o.id, o.customer_id, CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
           o.created_at, u.name AS customer_name, u.email AS customer_email
    FROM s_orders o JOIN s_customers u ON o.customer_id = u.id""", "s_orders", "s_customers"))
def q_orders_with_customer(spark, root):
    shop = DriverShop(spark, root)
    return customers.orders_with_customer(shop.orders, shop.customers)


@register("admin_orders_newest", "B9 C2 F5", with_ctes("""
    SELECT o.id, o.customer_id, CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
           o.created_at, u.name AS customer_name, u.email AS customer_email
    FROM s_orders o JOIN s_customers u ON o.customer_id = u.id
    ORDER BY o.created_at DESC, o.id DESC LIMIT 50""", "s_orders", "s_customers"))
def q_admin_orders_newest(spark, root):
    """The first screen of the admin's orders; ``orders_with_customer`` has them all."""
    shop = DriverShop(spark, root)
    return customers.newest_first(customers.orders_with_customer(shop.orders, shop.customers)).limit(50)


@register("order_scopes", "B5", with_ctes("""
    SELECT u.id AS viewer_id, u.role, CASE u.role WHEN 'admin' THEN 'all' ELSE 'own' END AS scope,
           CASE u.role WHEN 'admin' THEN (SELECT COUNT(*) FROM s_orders) ELSE COALESCE(o.n, 0) END AS visible_rows
    FROM (SELECT id, role FROM s_customers UNION ALL SELECT id, role FROM s_admins) u
    LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM s_orders GROUP BY 1) o ON o.customer_id = u.id""",
    "s_orders", "s_customers", "s_admins"))
def q_order_scopes(spark, root):
    shop = DriverShop(spark, root)
    people = shop.customers.unionByName(shop.admins).select(F.col("id").alias("user_id"), "role")
    return customers.session_scopes(shop.orders, "customer_id", people)


@register("visible_orders", "B5", with_ctes("""
    SELECT o.id, o.customer_id, CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
           o.created_at, u.id AS viewer_id
    FROM s_orders o JOIN s_customers u ON o.customer_id = u.id""", "s_orders", "s_customers"))
def q_visible_orders(spark, root):
    shop = DriverShop(spark, root)
    principals = shop.customers.select(F.col("id").alias("user_id"), "role")
    rows = customers.owned_rows(shop.orders, "customer_id", principals)
    return rows.select("id", "customer_id", F.col("total_amount").cast("double").alias("total_amount"),
                       "status", "created_at", "viewer_id")


@register("repeat_customers", "D5", with_ctes("""
    SELECT u.id, u.name, u.email, COUNT(*) AS order_count,
           CAST(SUM(o.total_amount) AS DOUBLE) AS lifetime_value
    FROM s_orders o JOIN s_customers u ON o.customer_id = u.id
    GROUP BY u.id, u.name, u.email HAVING COUNT(*) > 1
    ORDER BY order_count DESC, u.id ASC LIMIT 10""", "s_orders", "s_customers"))
def q_repeat_customers(spark, root):
    shop = DriverShop(spark, root)
    return customers.repeat_customers(shop.orders, shop.customers, k=10)


# --- behaviour ------------------------------------------------------------------

@register("page_stats", "D6 F1", with_ctes("""
    SELECT page, COUNT(*) AS views FROM s_page_views GROUP BY page
    ORDER BY views DESC, page ASC NULLS FIRST LIMIT 10""", "s_page_views"))
def q_page_stats(spark, root):
    return behavior.page_stats(DriverShop(spark, root).page_views, k=10)


@register("unique_visitors", "D7", with_ctes(
    "SELECT COUNT(DISTINCT session_id) AS visitors FROM s_page_views", "s_page_views"))
def q_unique_visitors(spark, root):
    return behavior.unique_visitors(DriverShop(spark, root).page_views)


@register("cart_conversion", "D8 H16 T7", with_ctes("""
    SELECT adds AS cart_additions, checkouts,
           CASE WHEN adds > 0
                THEN CAST(ROUND(CAST(checkouts AS DECIMAL(38,6)) * 100 / CAST(adds AS DECIMAL(38,6)), 1) AS DOUBLE)
                ELSE 0 END AS conversion_rate
    FROM (SELECT COUNT(*) FILTER (WHERE action = 'add') AS adds,
                 COUNT(*) FILTER (WHERE action = 'checkout') AS checkouts
          FROM s_cart_actions)""", "s_cart_actions"))
def q_cart_conversion(spark, root):
    return behavior.cart_conversion(DriverShop(spark, root).cart_actions)


@register("page_view_rows", "J1 H3 H4", f"""
    SELECT CAST(page_id AS VARCHAR) AS session_id, CAST(NULL AS BIGINT) AS user_id, path AS page,
           TRY_CAST(NULLIF(regexp_extract(path, '{DRIVER_ID_PATTERN}', 1), '') AS BIGINT) AS product_id,
           CAST(NULL AS TIMESTAMP) AS created_at
    FROM (SELECT page_id,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
          FROM pages)
    WHERE NOT starts_with(path, '/api') AND NOT contains(path, '.')""")
def q_page_view_rows(spark, root):
    return behavior.page_view_rows(DriverShop(spark, root).request_log, id_pattern=DRIVER_ID_PATTERN)


# --- H1, H2 on free text ---------------------------------------------------------

@register("sanitized_text", "H1 H2 T2 T3", f"""
    SELECT doc_id,
           {sql_sanitize('text', USER_TEXT_MAX)} AS user_text,
           {sql_sanitize('text', PRODUCT_TEXT_MAX)} AS product_text,
           {sql_sanitize('text', ENQUIRY_TEXT_MAX)} AS enquiry_text,
           {sql_email_ok("regexp_extract(text, '[^\\s@]*@\\S*', 0)")} AS has_valid_email
    FROM documents""")
def q_sanitized_text(spark, root):
    d = DriverShop(spark, root).table("documents")
    return d.select(
        "doc_id",
        sanitize(F.col("text"), USER_TEXT_MAX).alias("user_text"),
        sanitize(F.col("text"), PRODUCT_TEXT_MAX).alias("product_text"),
        sanitize(F.col("text"), ENQUIRY_TEXT_MAX).alias("enquiry_text"),
        email_ok(first_at_token(F.col("text"))).alias("has_valid_email"),
    )
