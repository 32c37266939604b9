"""Values that do not fit are rejected with a reason, never dropped or zeroed."""

from decimal import Decimal

from pyspark.sql import functions as F

from marketlens import schema as S
from marketlens.operators import behavior, changes, sales
from marketlens.sources.tables import rejected_sales_lines, type_sales_lines

TRACK = "productId string, action string, quantity string, session_id string, user_id long, ts timestamp"


def test_cart_actions_keep_large_ids_and_refuse_text_quantities(spark):
    raw = spark.createDataFrame([("3000000000", "add", "2", "s", 1, None), ("7", "add", "two", "s", 1, None),
                                 ("8", "add", "", "s", 1, None)], TRACK)
    accepted, rejected = behavior.cart_action_rows(raw)
    assert sorted((r.product_id, r.quantity) for r in accepted.collect()) == [(8, 1), (3000000000, 2)]
    assert [r.reason for r in rejected.collect()] == ["bad_quantity"]


def _upsert(spark, **fields):
    row = {"seq": 0, "product_id": None, "requester_id": 5, "name": "n", "description": "d", "price": "1",
           "bulk_price": None, "min_bulk_qty": None, "category": "c", "stock": None, "image_url": None} | fields
    kinds = {"seq": "long", "product_id": "long", "requester_id": "long"}
    form = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))
    table = spark.createDataFrame([], S.PRODUCTS)
    people = spark.createDataFrame([(5, "artisan")], "user_id long, role string")
    return changes.upsert_products(table, form, people)


def test_product_forms_with_unusable_numbers_are_refused(spark):
    for fields, reason in (({"price": "1e30"}, "bad_price"), ({"stock": "abc"}, "bad_stock"),
                           ({"bulk_price": "x"}, "bad_bulk_price"), ({"min_bulk_qty": "9999999999"}, "bad_min_bulk_qty")):
        after, rejected = _upsert(spark, **fields)
        assert [r.reason for r in rejected.collect()] == [reason] and after.count() == 0
    after, rejected = _upsert(spark, price="9.5", stock="3")
    assert [(r.price, r.stock) for r in after.collect()] == [(Decimal("9.50"), 3)] and rejected.count() == 0


def test_new_ids_do_not_collide_for_sequence_zero(spark):
    users = spark.createDataFrame([(9, "a", "a@b.c", "customer", "", "", None)],
                                  "id long, name string, email string, role string, phone string, address string, created_at timestamp_ntz")
    raw = spark.createDataFrame([(0, "x", "x@y.z", "customer", None, None), (1, "w", "w@y.z", "artisan", None, None)],
                                "seq long, name string, email string, role string, phone string, address string")
    accepted, _ = changes.intake_users(raw, users)
    assert sorted(r.id for r in accepted.collect()) == [10, 11]


def test_blank_date_does_not_stop_the_weekly_trend(spark):
    lines = spark.createDataFrame([(1, "", 2, Decimal(3)), (2, "2024-05-08", 1, Decimal(4))],
                                  "order_id long, created_at string, quantity long, line_total decimal(18,2)")
    got = {str(r.week): r.orders for r in sales.weekly_sales_trend(lines).collect()}
    assert got == {"None": 1, "2024-05-06": 1}


def test_unreadable_export_numbers_are_rejected_and_empty_is_zero(spark):
    columns = S.SALES_CSV_COLUMNS
    base = {c: "x" for c in columns} | {"quantity": "", "price": "", "total_amount": "5"}
    rows = [base, base | {"quantity": "3000000000"}, base | {"price": "oops"}, base | {"quantity": "1.x"}]
    raw = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
    assert sorted(r.quantity for r in type_sales_lines(raw).collect()) == [0, 3000000000]
    assert sorted(r.reason for r in rejected_sales_lines(raw).collect()) == ["bad_price", "bad_quantity"]


def test_artisans_and_customers_never_share_an_id(spark):
    from marketlens.sources.adapter import DriverShop

    shop = DriverShop(spark, "/root/testdata/sf0.001")
    ids = shop.customers.unionByName(shop.artisans).groupBy("id").count()
    assert ids.filter(F.col("count") > 1).count() == 0
