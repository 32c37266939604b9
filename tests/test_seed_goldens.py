"""Goldens worked out by hand from the reference's seed rows (FIXTURES.md §2)."""

from pyspark.sql import functions as F

from marketlens.operators import behavior, catalog, customers, kpis, sales
from tests.seed import AS_OF


def _lines(seed):
    return sales.sales_lines(seed["orders"], seed["users"], seed["order_items"], seed["products"])


def test_top_products_by_views(seed):
    rows = sales.top_products_by_views(seed["products"], seed["order_items"]).collect()
    assert [(r.id, r.views) for r in rows] == [
        (4, 200), (18, 180), (17, 160), (1, 150), (15, 140), (12, 130), (2, 120), (6, 110), (16, 110), (11, 100)]
    rev = {r.id: r.revenue for r in rows}
    assert rev[1] == 4500 and rev[2] == 3200 and rev[6] == 550 and rev[4] == 0
    assert {r.id: r.total_sold for r in rows}[1] == 1


def test_sales_by_category(seed):
    got = {r.category: (r.orders, r.units_sold, r.revenue)
           for r in sales.sales_by_category(seed["order_items"], seed["products"]).collect()}
    assert got == {"Terracotta Decor": (3, 4, 9400.0), "Dokra Metal Art": (4, 4, 5600.0)}


def test_daily_sales(seed):
    for days in (30, 7):
        rows = sales.daily_sales(seed["orders"], days, AS_OF).collect()
        assert [(str(r.date), r.orders, r.revenue) for r in rows] == [("2024-01-15", 4, 15000.0)]


def test_daily_sales_excludes_cancelled(seed, spark):
    orders = seed["orders"].withColumn(
        "status", F.when(F.col("id") == 3, F.lit("cancelled")).otherwise(F.col("status")))
    rows = sales.daily_sales(orders, 30, AS_OF).collect()
    assert [(r.orders, r.revenue) for r in rows] == [(3, 12600.0)]


def test_repeat_customers(seed):
    rows = customers.repeat_customers(seed["orders"], seed["users"]).collect()
    assert [(r.id, r.order_count, r.lifetime_value) for r in rows] == [(5, 2, 8550.0)]


def test_page_stats_and_visitors(seed):
    rows = behavior.page_stats(seed["page_views"]).collect()
    assert len(rows) == 5 and all(r.views == 10 for r in rows)
    assert behavior.unique_visitors(seed["page_views"]).first().visitors == 5


def test_page_view_seed_values(seed):
    pv = seed["page_views"]
    counts = {r.product_id: r["count"] for r in pv.groupBy("product_id").count().collect()}
    assert counts == {2: 10, 3: 10, 4: 10, None: 20}
    users = {r.user_id: r["count"] for r in pv.groupBy("user_id").count().collect()}
    assert users == {5: 17, 6: 17, None: 16}


def test_cart_conversion_empty(seed):
    r = behavior.cart_conversion(seed["cart_actions"]).first()
    assert (r.cart_additions, r.checkouts, r.conversion_rate) == (0, 0, 0.0)


def test_shop_kpis(seed):
    r = kpis.shop_kpis(seed["users"], seed["products"], seed["orders"], seed["b2b_enquiries"],
                       seed["page_views"]).first()
    assert tuple(r) == (7, 3, 3, 23, 4, 15000.0, 1, 50)


def test_category_menu(seed):
    got = [r.category for r in catalog.category_menu(seed["products"]).collect()]
    assert got == ["All", "Artisan Utility Products", "Bamboo & Wooden Crafts", "Dokra Metal Art",
                   "Folk & Hand-Painted Art", "Kantha Home Decor", "Terracotta Decor"]


def test_catalog_total_ignores_filter(seed):
    assert catalog.catalog_total(seed["products"]).first().total == 23


def test_customer_segments(seed):
    got = {r.email: (r.segment, r.orders, r.lifetime_value)
           for r in sales.customer_segments(_lines(seed)).collect()}
    assert got == {
        "buyer5@shop.example": ("loyal", 3, 8550.0),
        "buyer6@shop.example": ("loyal", 3, 4050.0),
        "buyer7@shop.example": ("new", 1, 2400.0),
    }
    counts = {r.segment: r.customers for r in sales.segment_counts(sales.customer_segments(_lines(seed))).collect()}
    assert counts == {"champions": 0, "loyal": 2, "at_risk": 0, "new": 1}


def test_best_sellers(seed):
    rows = sales.top_products_by_revenue(_lines(seed)).collect()
    assert [r.revenue for r in rows] == [4500, 3200, 2400, 1800, 1700, 850, 550]


def test_category_performance_and_totals(seed):
    lines = _lines(seed)
    perf = {r.category: r.order_count for r in sales.category_performance(lines).collect()}
    assert perf == {"Terracotta Decor": 3, "Dokra Metal Art": 3}
    t = sales.report_totals(sales.line_sales_trend(lines), sales.category_performance(lines), lines).first()
    assert (t.total_revenue, t.total_orders, t.total_records) == (15000.0, 4, 7)


def test_search(seed, spark):
    def ids(q):
        page = catalog.catalog_page(seed["products"], seed["users"], search=q, limit=100)
        return sorted(r.id for r in page.collect())

    assert ids("DOKRA") == [5, 6, 7, 8]
    assert ids("lamp") == [3, 15]
    assert ids("folk") == [1, 9, 11, 16, 17, 21]


def test_related_products(seed):
    rel = catalog.related_products(seed["products"]).collect()
    by = {}
    for r in rel:
        by.setdefault(r.product_id, []).append((r.position, r.related_id))
    assert [x for _, x in sorted(by[19])] == [20, 21, 22, 23]
    assert [x for _, x in sorted(by[12])] == [13, 14]


def test_order_product_names(seed, spark):
    from decimal import Decimal

    from marketlens import schema as S

    extra = spark.createDataFrame([(9, 7, Decimal(0), "pending", None, None, None)], S.ORDERS)
    orders = seed["orders"].unionByName(extra)
    got = {r.id: r.product_names for r in sales.order_product_names(orders, seed["order_items"],
                                                                     seed["products"]).collect()}
    assert got[2] == "Dokra Bull Sculpture, Dokra Tribal Musician Figurine, Handmade Clay Hanging Lamp"
    assert got[3] == "Dokra Wall Hanging Plate"
    assert got[9] is None


def test_keyset_paging_matches_offset(seed):
    first = catalog.catalog_page(seed["products"], seed["users"], limit=5).collect()
    second = catalog.catalog_page(seed["products"], seed["users"], limit=5, offset=5).collect()
    after = catalog.catalog_page_after(seed["products"], seed["users"], first[-1].views, first[-1].id,
                                       limit=5).collect()
    assert [r.id for r in first] == [4, 18, 17, 1, 15]
    assert [r.id for r in after] == [r.id for r in second] == [12, 2, 6, 16, 11]


def test_visible_rows_per_session(seed):
    assert customers.visible_rows(seed["orders"], "customer_id", 5, "customer").count() == 2
    assert customers.visible_rows(seed["orders"], "customer_id", 1, "admin").count() == 4


def test_shares_of_category_revenue(seed):
    shares = {r.category: (r.share_pct, r.of_max_pct) for r in
              sales.with_shares(sales.sales_by_category(seed["order_items"], seed["products"]), "revenue").collect()}
    assert shares == {"Terracotta Decor": (62.7, 100.0), "Dokra Metal Art": (37.3, 59.6)}
