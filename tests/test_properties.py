"""Properties from the test plan: totals agree across operators, shares add
up, change batches are idempotent, stream totals equal batch totals."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens import schema as S
from marketlens.operators import changes, sales
from marketlens.plans import load_all
from marketlens.sources.adapter import DriverShop

SF_DIR = "/root/testdata/sf0.001"


def test_line_and_category_revenue_agree(spark):
    shop = DriverShop(spark, SF_DIR)
    lines = sales.sales_lines(shop.orders, shop.customers, shop.order_items, shop.products())
    by_cat = sales.category_performance(lines).agg(F.sum("revenue").alias("r")).first().r
    by_day = sales.line_sales_trend(lines).agg(F.sum("revenue").alias("r")).first().r
    direct = float(lines.agg(F.sum("line_total")).first()[0])
    assert abs(by_cat - direct) < 0.01 and abs(by_day - direct) < 0.01
    d2 = sales.sales_by_category(shop.order_items, shop.products()).agg(F.sum("revenue")).first()[0]
    assert abs(d2 - float(shop.order_items.agg(F.sum("line_total")).first()[0])) < 0.01


def test_shares_sum_to_one_hundred(spark):
    shop = DriverShop(spark, SF_DIR)
    shares = sales.with_shares(sales.sales_by_category(shop.order_items, shop.products()), "revenue")
    rows = shares.collect()
    assert abs(sum(r.share_pct for r in rows) - 100.0) <= 0.05 * len(rows)
    assert max(r.of_max_pct for r in rows) == 100.0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from(changes.ORDER_STATUSES + ["lost", None]),
                          st.integers(0, 50)), min_size=1, max_size=12, unique_by=lambda t: t[2]))
def test_status_batches_are_idempotent(spark, seed, batch):
    ch = spark.createDataFrame(batch, S.STATUS_CHANGES)
    once, _ = changes.apply_status(seed["orders"], ch, changes.ORDER_STATUSES)
    twice, _ = changes.apply_status(once, ch, changes.ORDER_STATUSES)
    assert sorted(once.select("id", "status").collect()) == sorted(twice.select("id", "status").collect())
    valid = {}
    for i, s, q in sorted(batch, key=lambda t: t[2]):
        if s in changes.ORDER_STATUSES:
            valid[i] = s
    got = dict((r.id, r.status) for r in once.collect())
    for i, s in valid.items():
        if i in got:
            assert got[i] == s


def test_profile_batch_is_idempotent(spark, seed):
    ch = spark.createDataFrame([(5, " <A> ", "1", None, 1), (6, "B", None, "x", 2)],
                               "user_id long, name string, phone string, address string, seq long")
    once = changes.apply_profiles(seed["users"], ch)
    twice = changes.apply_profiles(once, ch)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_stream_totals_equal_batch_totals(spark):
    reg = load_all()
    stream = reg["stream_page_counts"].build(spark, SF_DIR).agg(F.sum("views")).first()[0]
    batch = DriverShop(spark, SF_DIR).page_views.count()
    assert stream == batch
    live = reg["stream_conversion"].build(spark, SF_DIR).first()
    static = reg["cart_conversion"].build(spark, SF_DIR).first()
    assert tuple(live) == tuple(static)
