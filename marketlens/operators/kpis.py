"""Shop KPIs (D9): eight figures in one row.

Each table is aggregated once (the three user counts share a scan) and the
figures are attached as scalar subqueries; nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double, cents_of, cents_to_money


def shop_kpis(users: DataFrame, products: DataFrame, orders: DataFrame,
              enquiries: DataFrame, views: DataFrame) -> DataFrame:
    spark = users.sparkSession
    people = users.select(F.struct(
        F.count(F.lit(1)).alias("all"),
        F.count_if(F.col("role") == "customer").alias("customers"),
        F.count_if(F.col("role") == "artisan").alias("artisans"),
    )).scalar()
    sales = orders.select(F.struct(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum(F.when(F.col("status") != "cancelled", cents_of(orders, "total_amount"))),
                   F.lit(0).cast("bigint")).alias("revenue"),
    )).scalar()
    return spark.range(1).select(
        people.getField("all").alias("total_users"),
        people.getField("customers").alias("total_customers"),
        people.getField("artisans").alias("total_artisans"),
        products.select(F.count(F.lit(1))).scalar().alias("total_products"),
        sales.getField("orders").alias("total_orders"),
        as_double(cents_to_money(sales.getField("revenue"))).alias("total_revenue"),
        enquiries.select(F.count_if(F.col("status") == "pending")).scalar().alias("pending_b2b"),
        views.select(F.count(F.lit(1))).scalar().alias("total_page_views"),
    )
