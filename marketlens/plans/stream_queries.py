"""Registered streaming queries.

Each runs its stream over the driver's files to completion
(``availableNow``), writes to a fresh folder under the shared checkpoint
folder, and returns the sink read back as a batch DataFrame, so the result
can be compared with the same figure computed in batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import behavior
from ..session import checkpoint_dir
from ..sources.adapter import CART_EVENT_ACTION, DriverShop, cart_from_events, requests_from_pages, views_from_events
from ..streaming import live
from .change_queries import _enquiries
from .oracle import with_ctes
from .registry import register
from .shop_queries import DRIVER_ID_PATTERN


def _scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register("stream_page_counts", "J3", with_ctes("""
    SELECT date_trunc('day', created_at) AS window_start, page, COUNT(*) AS views
    FROM s_page_views GROUP BY 1, 2""", "s_page_views"))
def q_stream_page_counts(spark, root):
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "page-counts")
    counts = live.live_page_counts(views_from_events(shop.stream("events")))
    _run(live.write_upserts(counts, out, ck, keys=["window_start", "page"]))
    result = live.read_upserts(spark, out, ["window_start", "page"])
    return result.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "page", "views")


@register("stream_conversion", "J4", with_ctes("""
    SELECT adds AS cart_additions, checkouts,
           CASE WHEN adds > 0
                THEN CAST(ROUND(CAST(checkouts AS DECIMAL(38,6)) * 100 / CAST(adds AS DECIMAL(38,6)), 1) AS DOUBLE)
                ELSE 0 END AS conversion_rate
    FROM (SELECT COUNT(*) FILTER (WHERE action = 'add') AS adds,
                 COUNT(*) FILTER (WHERE action = 'checkout') AS checkouts
          FROM s_cart_actions)""", "s_cart_actions"))
def q_stream_conversion(spark, root):
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "conversion")
    conv = live.live_conversion(cart_from_events(shop.stream("events")))
    _run(live.write_upserts(conv, out, ck, output_mode="complete"))
    df = spark.read.parquet(out)
    last = df.select(F.max("batch_id")).scalar()
    return df.where(F.col("batch_id") == last).drop("batch_id")


@register("stream_view_counters", "J5 I10", with_ctes("""
    SELECT p.id, p.views + COALESCE(v.n, 0) AS views FROM s_products p LEFT JOIN (
        SELECT product_id, COUNT(*) AS n FROM s_page_views GROUP BY product_id) v ON v.product_id = p.id""",
    "s_products", "s_page_views"))
def q_stream_view_counters(spark, root):
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "view-deltas")
    _run(live.write_view_deltas(views_from_events(shop.stream("events")), out, ck))
    deltas = live.view_deltas(out).read(spark).withColumnRenamed("views", "_n")
    p = shop.products()
    return p.join(deltas, p.id == deltas.product_id, "left").select(
        "id", (F.col("views") + F.coalesce(F.col("_n"), F.lit(0))).alias("views"))


def _delivered(spark, shop, name: str, parts: int):
    """The event log as a stream of ``parts`` files, one a micro-batch."""
    src, _ = _scratch(spark, name)
    events = shop.table("events")
    events.repartitionByRange(parts, "ts").write.parquet(src)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)


@register("stream_compacted_counters", "J5", with_ctes("""
    SELECT product_id, COUNT(*) AS views FROM s_page_views GROUP BY product_id""", "s_page_views"))
def q_stream_compacted_counters(spark, root):
    """View counters of 25 micro-batches through a sink folded every ten."""
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "compacted-counters")
    _run(live.write_view_deltas(views_from_events(_delivered(spark, shop, "compacted-events", 25)), out, ck))
    return live.view_deltas(out).read(spark)


@register("stream_live_visitors", "J3 D7", with_ctes("""
    SELECT COALESCE(CAST(CAST(created_at AS DATE) AS VARCHAR), 'all') AS span, COUNT(*) AS views,
           COUNT(DISTINCT session_id) AS visitors, TRUE AS within_bound
    FROM s_page_views GROUP BY GROUPING SETS ((CAST(created_at AS DATE)), ())""", "s_page_views"))
def q_stream_live_visitors(spark, root):
    """Visitors of every day and of all days from merged sketches, stated
    against the exact figure: does the estimate lie within the bound?"""
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "visitors")
    _run(live.write_visitor_sketches(views_from_events(_delivered(spark, shop, "visitor-events", 8)), out, ck, every=3))
    sketches = live.visitor_sketches(out).read(spark)
    span = F.coalesce(F.col("day").cast("string"), F.lit("all")).alias("span")
    found = live.visitors_of(sketches, "day").select(span, "views", "visitors").unionByName(
        live.visitors_of(sketches).select(F.lit("all").alias("span"), "views", "visitors"))
    days = shop.page_views.withColumn("day", F.to_date("created_at"))
    exact = days.groupBy("day").agg(F.count_distinct("session_id").alias("exact")).select(span, "exact").unionByName(
        behavior.unique_visitors(days).select(F.lit("all").alias("span"), F.col("visitors").alias("exact")))
    return found.join(exact, "span").select(
        "span", "views", F.col("exact").alias("visitors"),
        live.within_bound(F.col("visitors"), F.col("exact")).alias("within_bound"))


@register("stream_deduplicated_views", "J1", with_ctes("""
    SELECT id, session_id, user_id, page, product_id, created_at FROM s_page_views""", "s_page_views"))
def q_stream_deduplicated_views(spark, root):
    """Page views of a log delivered in three parts, each event twice and the
    last half hour of a part once more with the next; the stream is stopped
    and started between the parts and keeps each id once."""
    shop = DriverShop(spark, root)
    src, ck = _scratch(spark, "redelivered")
    out, _ = _scratch(spark, "deduplicated")
    events = shop.table("events")
    span = events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"),
                      F.unix_micros(F.max("ts").cast("timestamp")).alias("z")).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [span.a + (span.z + 1 - span.a) * k // 3 for k in range(4)]
    half_hour = 30 * 60 * 10**6
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = events.where((at >= a) & (at < z))
        again = events.where((at >= a - half_hour) & (at < z))
        part.unionByName(again).write.parquet(f"{src}/part{k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{src}/*")
        views = live.dedupe_events(views_from_events(stream))
        _run(live.write_append(views, out, ck))
    return spark.read.parquet(out).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register("stream_page_view_capture", "J1 H3 H4", f"""
    SELECT CAST(page_id AS VARCHAR) AS session_id, CAST(NULL AS BIGINT) AS user_id, path AS page,
           TRY_CAST(NULLIF(regexp_extract(path, '{DRIVER_ID_PATTERN}', 1), '') AS BIGINT) AS product_id,
           CAST(NULL AS TIMESTAMP) AS created_at
    FROM (SELECT page_id,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
          FROM pages)
    WHERE NOT starts_with(path, '/api') AND NOT contains(path, '.')""")
def q_stream_page_view_capture(spark, root):
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "page-views")
    rows = behavior.page_view_rows(requests_from_pages(shop.stream("pages")), id_pattern=DRIVER_ID_PATTERN)
    _run(live.write_append(rows, out, ck))
    return spark.read.parquet(out)


def _tracked_actions(events, *more):
    """Tracked cart requests as typed by the browser: text product id, an
    action word (error events send 'remove', views an unknown word, sign-ups none)."""
    action = F.when(F.lit(False), F.lit(None))
    for etype, name in {**CART_EVENT_ACTION, "error": "remove", "view": "view"}.items():
        action = action.when(F.col("event_type") == etype, F.lit(name))
    return events.select(
        F.get_json_object("props", "$.k").alias("productId"),
        action.alias("action"),
        F.lit(None).cast("int").alias("quantity"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("user_id"),
        F.col("ts"),
        *more,
    )


@register("stream_cart_actions", "J2 H12 H13", """
    SELECT CAST(user_id AS VARCHAR) AS session_id, user_id,
           TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
           CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'checkout'
                           WHEN 'error' THEN 'remove' END AS action,
           1 AS quantity, ts AS created_at
    FROM events WHERE event_type IN ('click', 'purchase', 'error')
      AND json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') != ''""")
def q_stream_cart_actions(spark, root):
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "cart-actions")
    _run(live.write_cart_actions(_tracked_actions(shop.stream("events")), f"{out}/accepted",
                                 f"{out}/rejected", ck))
    return spark.read.parquet(f"{out}/accepted").drop("batch_id")


@register("cart_action_rejected", "J2", """
    SELECT * FROM (
        SELECT event_id, CASE
            WHEN COALESCE(json_extract_string(props, '$.k'), '') = '' OR event_type NOT IN ('click', 'purchase', 'error', 'view')
              THEN 'missing_fields'
            WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'bad_product_id'
            WHEN event_type = 'view' THEN 'action_not_allowed' END AS reason
        FROM events) WHERE reason IS NOT NULL""")
def q_cart_action_rejected(spark, root):
    """Tracked actions that are refused, with the reason."""
    events = DriverShop(spark, root).table("events")
    _, rejected = behavior.cart_action_rows(_tracked_actions(events, "event_id"))
    return rejected.select("event_id", "reason")


@register("stream_cart_rejected", "J2", """
    SELECT reason, COUNT(*) AS actions FROM (
        SELECT CASE
            WHEN COALESCE(json_extract_string(props, '$.k'), '') = '' OR event_type NOT IN ('click', 'purchase', 'error', 'view')
              THEN 'missing_fields'
            WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'bad_product_id'
            WHEN event_type = 'view' THEN 'action_not_allowed' END AS reason
        FROM events) WHERE reason IS NOT NULL GROUP BY reason""")
def q_stream_cart_rejected(spark, root):
    """The side output of the streaming capture, counted by reason."""
    shop = DriverShop(spark, root)
    out, ck = _scratch(spark, "cart-rejected")
    _run(live.write_cart_actions(_tracked_actions(shop.stream("events")), f"{out}/accepted",
                                 f"{out}/rejected", ck))
    return spark.read.parquet(f"{out}/rejected").groupBy("reason").agg(F.count(F.lit(1)).alias("actions"))


# --- A2, A3: the sales export, read back as the offline report's input ----------------------

@register("report_from_export", "A2 A3 D16 H14", with_ctes("""
    SELECT category, CAST(ROUND(SUM(price * quantity), 2) AS DOUBLE) AS revenue,
           CAST(SUM(quantity) AS BIGINT) AS units_sold,
           COUNT(DISTINCT order_id) AS order_count
    FROM s_lines GROUP BY category""", "s_lines"))
def q_report_from_export(spark, root):
    from ..operators import sales
    from ..sources.sinks import write_sales_export
    from ..sources.tables import read_sales_csv, type_sales_lines

    shop = DriverShop(spark, root)
    out, _ = _scratch(spark, "sales-export")
    lines = sales.sales_lines(shop.orders, shop.customers, shop.order_items, shop.products())
    write_sales_export(lines.drop("line_total"), out)
    typed = type_sales_lines(read_sales_csv(spark, out))
    # Order ids stay text: the export writes order 0 as '', which the report
    # still counts as one distinct order, as the reference's script does.
    return sales.category_performance(typed)


@register("cart_action_rows", "J2 H12 H13", """
    SELECT CAST(user_id AS VARCHAR) AS session_id, user_id,
           TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
           CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'checkout'
                           WHEN 'error' THEN 'remove' END AS action,
           1 AS quantity, ts AS created_at
    FROM events WHERE event_type IN ('click', 'purchase', 'error')
      AND json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') != ''""")
def q_cart_action_rows(spark, root):
    """Batch form of the cart-action capture (same rules as the stream)."""
    accepted, _ = behavior.cart_action_rows(_tracked_actions(DriverShop(spark, root).table("events")))
    return accepted


@register("enquiry_export", "A4 H18", with_ctes("""
    SELECT CASE WHEN id = 0 THEN '' ELSE CAST(id AS VARCHAR) END AS id,
           company_name, contact_person, email, phone, product_category,
           CASE WHEN quantity IS NULL OR quantity = 0 THEN '' ELSE CAST(quantity AS VARCHAR) END AS quantity,
           message, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM s_enquiries""", "s_enquiries"))
def q_enquiry_export(spark, root):
    """The enquiry export (A4), read back as the text a spreadsheet would see."""
    from ..schema import ENQUIRY_CSV_COLUMNS
    from ..sources.sinks import write_enquiry_export

    out, _ = _scratch(spark, "enquiry-export")
    write_enquiry_export(_enquiries(DriverShop(spark, root)), out)
    schema = ", ".join(f"{c} string" for c in ENQUIRY_CSV_COLUMNS)
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).option("emptyValue", "").option("nullValue", "\\u0000")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out))
