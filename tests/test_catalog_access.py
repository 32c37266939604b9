"""Search by trigrams, deep pages, session scopes, new ids and creation times."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens import schema as S
from marketlens.operators import catalog, changes, customers, search

PRODUCTS = "id long, name string, description string"


def test_search_by_trigrams_equals_the_scan(spark, scratch_dir):
    rng = random.Random(5)
    letters = "abAB%_!c é"
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
    df = spark.createDataFrame([(i, text(), text()) for i in range(300)], PRODUCTS)
    search.write_postings(df, f"{scratch_dir}/postings", 8)
    postings = search.read_postings(spark, f"{scratch_dir}/postings")
    assert postings.count() > 0
    patterns = ["", "ab", "%", "abc", "AB a", "a_b%abA", "b!c", "ab%b", "é a", "ccc"] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(3, 5))) for _ in range(10)]
    for pattern in patterns:
        want = sorted(r.id for r in df.where(search.search_filter(pattern)).collect())
        got = sorted(r.id for r in search.search_products(df, postings, pattern, 8).collect())
        assert got == want, pattern


def test_search_reads_only_the_folders_of_its_trigrams(spark, scratch_dir):
    df = spark.createDataFrame([(1, "brass lamp", None)], PRODUCTS)
    search.write_postings(df, f"{scratch_dir}/postings", 64)
    found = search.search_products(df, search.read_postings(spark, f"{scratch_dir}/postings"), "lamp", 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and [r.id for r in found.collect()] == [1]


def test_pages_of_the_directory_equal_offset_pages(spark, seed):
    directory = catalog.PageDirectory(seed["products"], seed["users"], size=2)
    n = directory.pages
    assert n == -(-seed["products"].count() // 2)
    keys = {r.page: (r.views, r.id) for r in directory.start_keys().collect()}
    assert sorted(keys) == list(range(n))
    for page in range(n + 1):
        want = catalog.catalog_page(seed["products"], seed["users"], limit=2, offset=2 * page).collect()
        assert directory.page(page).collect() == want
        if want:
            assert keys[page] == (want[0].views, want[0].id)


def test_admins_are_no_owners(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, customer_id long")
    people = spark.createDataFrame([(5, "customer"), (7, "customer"), (9, "admin")], S.PRINCIPALS)
    with pytest.raises(Exception, match="an admin owns no rows"):
        customers.owned_rows(rows, "customer_id", people).collect()
    got = {r.viewer_id: (r.scope, r.visible_rows) for r in
           customers.session_scopes(rows, "customer_id", people).collect()}
    assert got == {5: ("own", 2), 7: ("own", 0), 9: ("all", 3)}


def test_related_products_leave_out_those_without_artisan(spark):
    p = spark.createDataFrame([(1, "A", 1), (2, "A", 2), (3, "A", 1), (4, "A", 9)],
                              "id long, category string, artisan_id long")
    u = spark.createDataFrame([(1, "Ann"), (2, "Bea")], "id long, name string")
    got = sorted(tuple(r) for r in catalog.related_products(p, 4, u).collect())
    assert got == [(1, 2, 1, "Bea"), (1, 3, 2, "Ann"), (2, 1, 1, "Ann"), (2, 3, 2, "Ann"),
                   (3, 1, 1, "Ann"), (3, 2, 2, "Bea")]


def test_newest_first_orders_by_time_then_id(spark):
    rows = [(1, 3), (2, 5), (3, 5), (4, None)]
    df = spark.createDataFrame(rows, "id long, s long").select(
        "id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("created_at"))
    assert [r.id for r in customers.newest_first(df).collect()] == [3, 2, 1, 4]


def test_new_ids_follow_the_stored_ones_however_long_a_cart_is(spark):
    n = 70_000
    carts = spark.range(1).select(
        F.lit(1 << 50).alias("cart_id"), F.lit(1).cast("long").alias("seq"), F.lit(4).cast("long").alias("customer_id"),
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(
            F.lit(1).cast("long").alias("productId"), F.lit(1).alias("quantity"))).alias("items"),
        F.lit(None).cast("string").alias("shipping_address"), F.lit(None).cast("string").alias("payment_method"))
    products = spark.createDataFrame([(1, Decimal(5), n + 1)], "id bigint, price decimal(18,2), stock int")
    res = changes.intake_orders(carts, products, last_ids={"orders": 10, "order_items": 100, "cart_actions": 1000})
    assert [r.id for r in res.orders.collect()] == [11]
    lines = res.items.agg(F.min("id"), F.max("id"), F.count_distinct("id"), F.min("order_id")).first()
    assert tuple(lines) == (101, 100 + n, n, 11)
    assert res.cart_events.agg(F.min("id")).first()[0] == 1001


def test_new_rows_carry_their_time_of_creation(spark, seed):
    at = F.lit("2024-03-04 05:06:07").cast("timestamp_ntz")
    form = spark.createDataFrame(
        [(1, None, 2, "Pot", None, "5", None, None, "Clay", None, None)],
        "seq long, product_id long, requester_id long, name string, description string, price string, "
        "bulk_price string, min_bulk_qty string, category string, stock string, image_url string")
    people = spark.createDataFrame([(2, "artisan")], S.PRINCIPALS)
    table, rejected = changes.upsert_products(seed["products"], form, people, at)
    assert rejected.count() == 0
    new = table.where("name = 'Pot'").first()
    assert str(new.created_at) == "2024-03-04 05:06:07"
