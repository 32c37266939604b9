"""Sales operators: joins to sales lines and everything grouped from them.

Shapes chosen for scale:

* Aggregate order lines per product *before* joining the catalogue (D1, D2):
  the partial aggregate runs map-side, so a product that holds a third of
  all lines costs one row per map task, and the join becomes one-to-one.
* Top-k lists end in ``orderBy(...).limit(k)`` (TakeOrderedAndProject: a
  per-partition top-k, then a k-row merge) with a unique tie-break.
* Distinct counts use Spark's two-level distinct aggregation, which shuffles
  on (key, value) first, so a hot key is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double, cents_of, cents_to_money, zero_if_null
from ..functions.text import first_ten
from ..session import materialize


def line_revenue(items: DataFrame) -> Column:
    """Revenue of one line in whole cents (bigint): the line's own total when
    present, else quantity × unit price.  Sums of cents are exact and about
    twice as fast as decimal sums; results go back to money at the end."""
    if "line_total" in items.columns or "line_total_cents" in items.columns:
        return cents_of(items, "line_total")
    return F.col("quantity").cast("bigint") * cents_of(items, "price")


def _money_out(c: Column) -> Column:
    """A sum of cents as the double the queries return."""
    return as_double(cents_to_money(c))


# --- C3: the denormalised sales lines ---------------------------------------

def sales_lines(orders: DataFrame, users: DataFrame, items: DataFrame,
                products: DataFrame) -> DataFrame:
    """orders ⋈ users ⋈ order_items ⋈ products, one row per order line.

    Orders meet their customers at order grain first, then the lines join on
    the order id and the products on the product id.  Spark broadcasts a side
    it has measured small; otherwise these are sort-merge joins whose skewed
    partitions AQE splits.
    """
    o = orders.select(
        F.col("id").alias("order_id"), F.col("customer_id"), "total_amount", "status", "created_at"
    )
    u = users.select(F.col("id").alias("customer_id"), F.col("name").alias("customer"), "email")
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"), "category")
    cols = ["order_id", "product_id", "quantity", "price"]
    cols += [c for c in ("line_total", "line_total_cents") if c in items.columns]
    li = items.select(*cols)
    return (
        o.join(u, "customer_id")
        .join(li, "order_id")
        .join(p, "product_id")
        .select(
            "order_id", "customer", "email", "total_amount", "status", "created_at",
            "product", "category", "quantity", "price",
            *[c for c in ("line_total", "line_total_cents") if c in cols],
        )
    )


# --- dashboard aggregates ---------------------------------------------------

def top_products_by_views(products: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Most viewed products with their sales.

    ``total_sold`` counts item rows, revenue is 0 for unsold products, and
    cancelled orders count.  The k most viewed products are picked first
    (a k-row result), so only their lines are aggregated.
    """
    top = (
        products.select("id", "name", "category", "views", "price")
        .orderBy(F.col("views").desc(), F.col("id").asc())
        .limit(k)
    )
    # ``top`` has exactly k rows, so broadcasting it is bounded by k.
    sold = (
        items.join(F.broadcast(top.select(F.col("id").alias("product_id"))), "product_id", "left_semi")
        .groupBy("product_id")
        .agg(F.count("order_id").alias("total_sold"), F.sum(line_revenue(items)).alias("revenue"))
    )
    return (
        top.join(sold, top.id == sold.product_id, "left")
        .select(
            "id", "name", "category", "views",
            as_double(F.col("price")).alias("price"),
            zero_if_null(F.col("total_sold")).alias("total_sold"),
            _money_out(F.coalesce(F.col("revenue"), F.lit(0).cast("bigint"))).alias("revenue"),
        )
        .orderBy(F.col("views").desc(), F.col("id").asc())
    )


def product_sales(items: DataFrame) -> DataFrame:
    """Per-product item rows, units and revenue: the map-side pre-aggregate."""
    return items.groupBy("product_id").agg(
        F.count("order_id").alias("lines"),
        F.sum("quantity").alias("units"),
        F.sum(line_revenue(items)).alias("revenue"),
    )


def sales_by_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Item rows, units and revenue per category, revenue first.

    ``orders`` counts item rows, not distinct orders (T8); cancelled orders
    count (T9).
    """
    per_product = product_sales(items)
    p = products.select(F.col("id").alias("product_id"), "category")
    return (
        per_product.join(p, "product_id")
        .groupBy("category")
        .agg(
            F.sum("lines").alias("orders"),
            F.sum("units").cast("bigint").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
        )
        .select("category", "orders", "units_sold", _money_out(F.col("revenue")).alias("revenue"))
        .orderBy(F.col("revenue").desc(), F.col("category").asc())
    )


def trailing_days(df: DataFrame, ts_col: str, days: int, as_of: str) -> DataFrame:
    """``ts >= date(as_of, -days)``: from that midnight on, no upper bound."""
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    return df.where(F.col(ts_col) >= start.cast("timestamp_ntz"))


def exclude_status(df: DataFrame, status: str = "cancelled") -> DataFrame:
    """``status != x``; a NULL status drops out too, as in SQL."""
    return df.where(F.col("status") != F.lit(status))


def daily_sales(orders: DataFrame, days: int, as_of: str,
                excluded: str | None = "cancelled") -> DataFrame:
    """Orders and revenue per day over a trailing window.

    Days without orders are absent, as in the reference.
    """
    o = trailing_days(orders, "created_at", days, as_of)
    if excluded is not None:
        o = exclude_status(o, excluded)
    return (
        o.groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(cents_of(orders, "total_amount")).alias("revenue"))
        .select("date", "orders", _money_out(F.col("revenue")).alias("revenue"))
        .orderBy("date")
    )


def restock_units(cancelled_orders: DataFrame, items: DataFrame) -> DataFrame:
    """Units to put back per product for cancelled orders."""
    ids = cancelled_orders.select(F.col("id").alias("order_id"))
    return (
        items.join(ids, "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("quantity").cast("bigint").alias("units"))
    )


def order_product_names(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Every order with the names of its products, ', '-joined.

    The reference's ``GROUP_CONCAT`` order is unspecified; names are sorted
    here.  Orders without lines (or whose products are gone) get NULL.
    """
    p = products.select(F.col("id").alias("product_id"), "name")
    names = (
        items.select("order_id", "product_id")
        .join(p, "product_id", "left")
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_list("name")).alias("names"))
        .select(
            "order_id",
            F.when(F.size("names") > 0, F.array_join("names", ", ")).alias("product_names"),
        )
    )
    return orders.join(names, orders.id == names.order_id, "left").select(
        orders.id, orders.customer_id, as_double(orders.total_amount).alias("total_amount"),
        orders.status, orders.created_at, names.product_names,
    )


# --- offline report over sales lines (D13–D18) -------------------------------

def line_sales_trend(lines: DataFrame) -> DataFrame:
    """Distinct orders, revenue and units per day of ``created_at`` text."""
    rev = line_revenue(lines)
    return (
        lines.groupBy(first_ten(F.col("created_at")).alias("date"))
        .agg(
            F.count_distinct("order_id").alias("orders"),
            F.sum(rev).alias("revenue"),
            F.sum("quantity").cast("bigint").alias("units_sold"),
        )
        .select("date", "orders", _money_out(F.col("revenue")).alias("revenue"), "units_sold")
        .orderBy("date")
    )


def last_days(trend: DataFrame, k: int = 7) -> DataFrame:
    """The last ``k`` entries of a trend, oldest first."""
    return trend.orderBy(F.col("date").desc()).limit(k).orderBy("date")


# Segment thresholds (line count, revenue) and the labels.
CHAMPION_MIN_LINES = 5
CHAMPION_MIN_REVENUE = 10000
LOYAL_MIN_LINES = 3
AT_RISK_MIN_LINES = 2
SEGMENTS = ["champions", "loyal", "at_risk", "new"]


def customer_segments(lines: DataFrame) -> DataFrame:
    """Customer segment by email: line count and revenue thresholds.

    "orders" counts lines; rows with an empty email are skipped; the
    customer's name is the greatest name seen for the email.
    """
    rev = line_revenue(lines)
    per = (
        lines.where(F.col("email").isNotNull() & (F.col("email") != ""))
        .groupBy("email")
        .agg(
            F.max("customer").alias("name"),
            F.count(F.lit(1)).alias("orders"),
            F.sum(rev).alias("revenue"),
        )
    )
    seg = (
        F.when((F.col("orders") >= CHAMPION_MIN_LINES) & (F.col("revenue") >= CHAMPION_MIN_REVENUE * 100),
               F.lit("champions"))
        .when(F.col("orders") >= LOYAL_MIN_LINES, F.lit("loyal"))
        .when(F.col("orders") >= AT_RISK_MIN_LINES, F.lit("at_risk"))
        .otherwise(F.lit("new"))
    )
    return per.select(
        seg.alias("segment"), "name", "email", "orders",
        _money_out(F.col("revenue")).alias("lifetime_value"),
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    """Customers per segment, zero-filled over the four labels."""
    spark = segments.sparkSession
    labels = spark.createDataFrame([(s, i) for i, s in enumerate(SEGMENTS)], "segment string, position int")
    counts = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    # The label frame has four rows by definition.
    return (
        F.broadcast(labels).join(counts, "segment", "left")
        .select("segment", zero_if_null(F.col("customers")).alias("customers"), "position")
        .orderBy("position")
        .drop("position")
    )


def top_products_by_revenue(lines: DataFrame, k: int = 10) -> DataFrame:
    """Best sellers keyed by product name: units and revenue, top k."""
    rev = line_revenue(lines)
    return (
        lines.groupBy(F.col("product").alias("name"))
        .agg(
            F.max("category").alias("category"),
            F.sum("quantity").cast("bigint").alias("units"),
            F.sum(rev).alias("revenue_exact"),
        )
        .orderBy(F.col("revenue_exact").desc(), F.col("name").asc())
        .limit(k)
        .select("name", "category", "units", _money_out(F.col("revenue_exact")).alias("revenue"))
    )


def category_performance(lines: DataFrame) -> DataFrame:
    """Revenue, units and distinct orders per category."""
    rev = line_revenue(lines)
    return (
        lines.groupBy("category")
        .agg(
            F.sum(rev).alias("revenue_exact"),
            F.sum("quantity").cast("bigint").alias("units_sold"),
            F.count_distinct("order_id").alias("order_count"),
        )
        .orderBy(F.col("revenue_exact").desc(), F.col("category").asc())
        .select("category", _money_out(F.col("revenue_exact")).alias("revenue"),
                "units_sold", "order_count")
    )


def report_totals(trend: DataFrame, categories: DataFrame, lines: DataFrame) -> DataFrame:
    """Σ rounded category revenue, Σ daily distinct orders, record count.

    Three one-row scalar subqueries; no join between the inputs.
    """
    spark = lines.sparkSession
    return spark.range(1).select(
        as_double(categories.select(F.sum(F.col("revenue").cast("decimal(38,2)"))).scalar())
        .alias("total_revenue"),
        F.coalesce(trend.select(F.sum("orders")).scalar(), F.lit(0)).cast("bigint").alias("total_orders"),
        lines.select(F.count(F.lit(1))).scalar().alias("total_records"),
    )


# --- shares (E1, E2) ----------------------------------------------------------

def with_shares(df: DataFrame, value_col: str, floor: float | None = None) -> DataFrame:
    """Add percent of total (one decimal) and percent of maximum.

    Meant for grouped, small results (one row per category or day).  The
    total and the maximum are one-row scalar subqueries, so no single task
    ever holds the whole input.
    """
    # Written once: the rows, their total and their maximum share one scan.
    df = materialize(df, "shares")
    v = F.col(value_col).cast("decimal(38,2)")
    total = df.select(F.sum(F.col(value_col).cast("decimal(38,2)"))).scalar()
    peak = df.select(F.max(F.col(value_col).cast("decimal(38,2)"))).scalar()
    if floor is not None:
        peak = F.greatest(peak, F.lit(floor).cast("decimal(38,2)"))
    share = F.round(F.try_divide(v * 100, total), 1)
    of_max = F.round(F.try_divide(v * 100, peak), 1)
    return df.select(
        "*",
        as_double(F.coalesce(share, F.lit(0))).alias("share_pct"),
        as_double(F.coalesce(of_max, F.lit(0))).alias("of_max_pct"),
    )


def weekly_sales_trend(lines: DataFrame) -> DataFrame:
    """Extension (claimed in prose only): D13 by ISO week start; lines without a
    readable date share the NULL week."""
    rev = line_revenue(lines)
    week = F.to_date(F.date_trunc("week", F.try_to_timestamp(first_ten(F.col("created_at")))))
    return (
        lines.groupBy(week.alias("week"))
        .agg(
            F.count_distinct("order_id").alias("orders"),
            F.sum(rev).alias("revenue"),
            F.sum("quantity").cast("bigint").alias("units_sold"),
        )
        .select("week", "orders", _money_out(F.col("revenue")).alias("revenue"), "units_sold")
        .orderBy("week")
    )


def artisan_sales(items: DataFrame, products: DataFrame, artisans: DataFrame) -> DataFrame:
    """Extension (claimed in prose only): sales per artisan of the products."""
    per_product = product_sales(items)
    p = products.select(F.col("id").alias("product_id"), "artisan_id")
    a = artisans.select(F.col("id").alias("artisan_id"), F.col("name").alias("artisan_name"))
    return (
        per_product.join(p, "product_id")
        .groupBy("artisan_id")
        .agg(
            F.sum("lines").alias("lines"),
            F.sum("units").cast("bigint").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
        )
        .join(a, "artisan_id")
        .select("artisan_id", "artisan_name", "lines", "units_sold",
                _money_out(F.col("revenue")).alias("revenue"))
    )
