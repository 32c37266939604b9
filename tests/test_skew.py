"""One key holding a third of all rows: results stay exact and the hot
partition is split instead of landing in one task."""

import contextlib
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens import schema as S
from marketlens.operators import catalog, sales
from marketlens.operators.windows import sum_before

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(11)
    n = 30_000
    items = [(i, i // 3, 1 if i % 3 == 0 else rng.randint(2, 400), rng.randint(1, 5), Decimal("10.00"))
             for i in range(n)]
    products = [(p, f"p{p}", None, Decimal("10.00"), None, 10, f"c{p % 7}", 2, None, 50, 0, None)
                for p in range(1, 401)]
    return (spark.createDataFrame(items, S.ORDER_ITEMS), spark.createDataFrame(products, S.PRODUCTS))


def final_plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_hot_product_join_is_split(spark, skewed):
    items, products = skewed
    users = spark.createDataFrame([(2, "a", "a@x.com", "artisan", None, "X", None)], S.USERS)
    orders = items.select(F.col("order_id").alias("id")).distinct()
    with conf(spark, SKEW_CONF):
        df = catalog.order_detail(orders, items, products, users)
        got = df.groupBy("product_id").agg(F.sum("quantity").alias("q"))
        rows = {r.product_id: r.q for r in got.collect()}
        joined = df.select("order_id", "product_id", "quantity")
        assert len(joined.collect()) == items.count()
        plan = final_plan(joined)
    want = {r.product_id: r.q for r in items.groupBy("product_id").agg(F.sum("quantity").alias("q")).collect()}
    assert rows == want
    assert "isFinalPlan=true" in plan and "skew=true" in plan


def test_hot_product_aggregates_stay_exact(spark, skewed):
    items, products = skewed
    with conf(spark, SKEW_CONF):
        got = {r.category: (r.orders, r.units_sold) for r in sales.sales_by_category(items, products).collect()}
    per = items.join(products.select(F.col("id").alias("product_id"), "category"), "product_id")
    want = {r.category: (r.o, r.u) for r in per.groupBy("category").agg(
        F.count(F.lit(1)).alias("o"), F.sum("quantity").alias("u")).collect()}
    assert got == want


def test_running_sums_split_a_hot_key(spark, skewed):
    items, _ = skewed
    out = sum_before(items, "product_id", "id", {"before": F.col("quantity")}, bucket_width=1000)
    hot = out.where("product_id = 1").orderBy("id").select("quantity", "before").collect()
    running = 0
    for r in hot:
        assert r.before == running
        running += r.quantity
    # the hot key is spread over (key, bucket) partitions, never one task
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    assert "hashpartitioning(product_id#" in buf.getvalue() and "_bucket" in buf.getvalue()
