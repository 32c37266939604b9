"""Registered change-batch, quality and KPI queries over the driver tables.

The driver's data has no request logs, so each change batch is derived by
a fixed rule from the tables themselves (its size grows with them): order
priorities become status changes and cancellations, customers' market
segments become profile edits, documents become enquiry and registration
forms, order history becomes a replay of carts against current stock.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_at_token
from ..operators import changes, customers, kpis, quality
from ..sources.adapter import ADMIN_BASE, ARTISAN_BASE, DriverShop
from .oracle import CTES, sql_email_ok, sql_falsy, sql_sanitize, with_ctes
from .registry import register
from .shop_queries import DRIVER_ID_PATTERN


# Places of lines in a stored order's key range (line numbers run from 1 to 7).
LINES_OF_AN_ORDER = 8
AS_OF = "2024-01-01 00:00:00"  # the business time of the intakes


def _as_of(seconds=None):
    start = F.lit(AS_OF).cast("timestamp_ntz")
    return start if seconds is None else start + F.make_dt_interval(secs=F.col(seconds))


def _enquiries(shop: DriverShop):
    # Forms arrive one a second, in the order of their ids.
    accepted, _ = changes.intake_enquiries(shop.raw_enquiries, _as_of("id"))
    return accepted


# --- I3: order status changes --------------------------------------------------------

def _requests(df, *wanted):
    """Requests made of a table's rows in one scan: for each (condition,
    columns) of ``wanted`` a row where the condition holds."""
    made = F.array(*[F.when(when, F.struct(*columns)) for when, columns in wanted])
    rows = df.select(F.explode(F.filter(made, lambda r: r.isNotNull())).alias("r"))
    return rows.select("r.*")


def _status_change(key, status, seq):
    return [F.col(key).alias("id"), F.lit(status).alias("status"), F.lit(seq).cast("bigint").alias("seq")]


def _status_changes(shop: DriverShop):
    priority = F.col("o_orderpriority")
    return _requests(
        shop.table("orders").where(priority.isin("1-URGENT", "2-HIGH", "5-LOW")),
        (priority.isin("1-URGENT", "2-HIGH"), _status_change("o_orderkey", "shipped", 1)),
        ((priority == "1-URGENT") & (F.col("o_orderstatus") == "F"), _status_change("o_orderkey", "delivered", 2)),
        (priority == "5-LOW", _status_change("o_orderkey", "lost", 3)))


CTES["s_status_changes"] = ((), """
        SELECT o_orderkey AS id, 'shipped' AS status, 1 AS seq FROM orders
          WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
        UNION ALL SELECT o_orderkey, 'delivered', 2 FROM orders
          WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, 'lost', 3 FROM orders WHERE o_orderpriority = '5-LOW'""")
_ORDER_STATUS_LIST = "('pending', 'confirmed', 'shipped', 'delivered', 'cancelled')"


@register("order_status_apply", "I3", with_ctes(f"""
    SELECT o.id, o.customer_id, CAST(o.total_amount AS DOUBLE) AS total_amount,
           COALESCE(c.status, o.status) AS status, o.created_at
    FROM s_orders o LEFT JOIN (
        SELECT id, arg_max(status, seq) AS status FROM s_status_changes
        WHERE status IN {_ORDER_STATUS_LIST} GROUP BY id) c ON c.id = o.id""",
    "s_orders", "s_status_changes"))
def q_order_status_apply(spark, root):
    shop = DriverShop(spark, root)
    new, _ = changes.apply_status(shop.orders, _status_changes(shop), changes.ORDER_STATUSES)
    return new.select("id", "customer_id", F.col("total_amount").cast("double").alias("total_amount"),
                      "status", "created_at")


@register("order_status_rejected", "I3", with_ctes(f"""
    SELECT id, status, CAST(seq AS BIGINT) AS seq, 'status_not_allowed' AS reason FROM s_status_changes
    WHERE status IS NULL OR status NOT IN {_ORDER_STATUS_LIST}""", "s_status_changes"))
def q_order_status_rejected(spark, root):
    shop = DriverShop(spark, root)
    _, rejected = changes.apply_status(shop.orders, _status_changes(shop), changes.ORDER_STATUSES)
    return rejected


# --- I4, I5, B9: enquiries -----------------------------------------------------------------

@register("enquiry_intake", "I5 H1 H2 H13", with_ctes("""
    SELECT id, company_name, contact_person, email, phone, product_category, quantity, message, status,
           created_at
    FROM s_enquiries""", "s_enquiries"))
def q_enquiry_intake(spark, root):
    return _enquiries(DriverShop(spark, root))


@register("enquiry_rejections", "I5", with_ctes("""
    SELECT reason, COUNT(*) AS requests FROM s_enquiry_checked WHERE reason IS NOT NULL
    GROUP BY reason""", "s_enquiry_checked"))
def q_enquiry_rejections(spark, root):
    _, rejected = changes.intake_enquiries(DriverShop(spark, root).raw_enquiries)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


@register("enquiry_list", "B9 F5", with_ctes("""
    SELECT id, company_name, contact_person, email, status, created_at FROM s_enquiries""", "s_enquiries"))
def q_enquiry_list(spark, root):
    e = _enquiries(DriverShop(spark, root))
    return customers.newest_first(e).select("id", "company_name", "contact_person", "email", "status",
                                            "created_at")


@register("enquiries_newest", "B9 F5", with_ctes("""
    SELECT id, company_name, status, created_at FROM s_enquiries
    ORDER BY created_at DESC, id DESC LIMIT 50""", "s_enquiries"))
def q_enquiries_newest(spark, root):
    """The first screen of the list: its order decides which rows these are."""
    e = _enquiries(DriverShop(spark, root))
    return customers.newest_first(e).limit(50).select("id", "company_name", "status", "created_at")


def _enquiry_changes(e):
    # Every enquiry is reviewed; German-language ones are then accepted and
    # English ones get a status that is not allowed.
    return _requests(
        e, (F.lit(True), _status_change("id", "reviewed", 1)),
        (F.col("contact_person") == "de", _status_change("id", "accepted", 2)),
        (F.col("contact_person") == "en", _status_change("id", "archived", 3)))


@register("enquiry_status_rejected", "I4", with_ctes("""
    SELECT id, 'archived' AS status, CAST(3 AS BIGINT) AS seq, 'status_not_allowed' AS reason
    FROM s_enquiries WHERE contact_person = 'en'""", "s_enquiries"))
def q_enquiry_status_rejected(spark, root):
    e = _enquiries(DriverShop(spark, root))
    _, rejected = changes.apply_status(e, _enquiry_changes(e), changes.ENQUIRY_STATUSES)
    return rejected


@register("enquiry_status_apply", "I4", with_ctes("""
    SELECT e.id, COALESCE(c.status, e.status) AS status FROM s_enquiries e LEFT JOIN (
        SELECT id, arg_max(status, seq) AS status FROM (
            SELECT id, 'reviewed' AS status, 1 AS seq FROM s_enquiries
            UNION ALL SELECT id, 'accepted', 2 FROM s_enquiries WHERE contact_person = 'de'
            UNION ALL SELECT id, 'archived', 3 FROM s_enquiries WHERE contact_person = 'en')
        WHERE status IN ('pending', 'reviewed', 'accepted', 'rejected') GROUP BY id) c ON c.id = e.id""",
    "s_enquiries"))
def q_enquiry_status_apply(spark, root):
    e = _enquiries(DriverShop(spark, root))
    new, _ = changes.apply_status(e, _enquiry_changes(e), changes.ENQUIRY_STATUSES)
    return new.select("id", "status")


# --- I2: cancellations --------------------------------------------------------------------

def _cancel_requests(shop: DriverShop):
    priority = F.col("o_orderpriority")

    def request(stranger, again):
        return [F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") + stranger).alias("requester_id"),
                (F.col("o_orderkey") * 2 + again).alias("seq")]

    own = priority == "5-LOW"
    return _requests(
        shop.table("orders").where(priority.isin("5-LOW", "4-NOT SPECIFIED")),
        (own, request(0, 0)), (own, request(0, 1)), (~own, request(1, 0)))


CTES["s_cancel_requests"] = ((), """
        SELECT o_orderkey AS order_id, o_custkey AS requester_id, o_orderkey * 2 AS seq
          FROM orders WHERE o_orderpriority = '5-LOW'
        UNION ALL SELECT o_orderkey, o_custkey, o_orderkey * 2 + 1 FROM orders WHERE o_orderpriority = '5-LOW'
        UNION ALL SELECT o_orderkey, o_custkey + 1, o_orderkey * 2 FROM orders
          WHERE o_orderpriority = '4-NOT SPECIFIED'""")
CTES["s_cancel_judged"] = (("s_cancel_requests", "s_orders"), """
        SELECT r.*, CASE WHEN o.id IS NULL THEN 'unknown_order'
                         WHEN r.requester_id IS DISTINCT FROM o.customer_id THEN 'not_permitted'
                         WHEN o.status IS NULL OR o.status NOT IN ('pending', 'confirmed')
                           THEN 'not_cancellable:' || COALESCE(o.status, 'null') END AS reason0
        FROM s_cancel_requests r LEFT JOIN s_orders o ON o.id = r.order_id""")
CTES["s_cancel_winners"] = (("s_cancel_judged",), """
        SELECT order_id, MIN(seq) AS win FROM s_cancel_judged WHERE reason0 IS NULL GROUP BY order_id""")


@register("order_cancellation", "I2", with_ctes("""
    SELECT o.id, CASE WHEN w.order_id IS NOT NULL THEN 'cancelled' ELSE o.status END AS status
    FROM s_orders o LEFT JOIN s_cancel_winners w ON w.order_id = o.id""", "s_orders", "s_cancel_winners"))
def q_order_cancellation(spark, root):
    shop = DriverShop(spark, root)
    new_orders, _, _ = changes.cancel_orders(_cancel_requests(shop), shop.orders, shop.order_items,
                                             shop.products())
    return new_orders.select("id", "status")


@register("cancellation_restock", "I2 D21", with_ctes("""
    SELECT p.id, CAST(p.stock + COALESCE(b.units, 0) AS INTEGER) AS stock FROM s_products p LEFT JOIN (
        SELECT product_id, SUM(quantity) AS units FROM s_items
        WHERE order_id IN (SELECT order_id FROM s_cancel_winners) GROUP BY product_id) b
      ON b.product_id = p.id""", "s_products", "s_items", "s_cancel_winners"))
def q_cancellation_restock(spark, root):
    shop = DriverShop(spark, root)
    _, new_products, _ = changes.cancel_orders(_cancel_requests(shop), shop.orders, shop.order_items,
                                               shop.products())
    return new_products.select("id", "stock")


@register("cancellation_rejected", "I2", with_ctes("""
    SELECT j.order_id, j.requester_id, j.seq,
           COALESCE(j.reason0, 'not_cancellable:cancelled') AS reason
    FROM s_cancel_judged j LEFT JOIN s_cancel_winners w ON w.order_id = j.order_id
    WHERE j.reason0 IS NOT NULL OR j.seq != w.win""", "s_cancel_judged", "s_cancel_winners"))
def q_cancellation_rejected(spark, root):
    shop = DriverShop(spark, root)
    _, _, rejected = changes.cancel_orders(_cancel_requests(shop), shop.orders, shop.order_items,
                                           shop.products())
    return rejected


# --- I9: profiles ---------------------------------------------------------------------------

def _profile_changes(shop: DriverShop):
    c = shop.table("customer").where(F.col("c_mktsegment") == "BUILDING")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit(" <b>")).alias("name"),
        F.concat(F.lit("'555-"), F.col("c_custkey").cast("string"), F.lit("'")).alias("phone"),
        F.lit(None).cast("string").alias("address"),
        F.lit(1).cast("bigint").alias("seq"),
    )


@register("profile_apply", "I9 H1", with_ctes(f"""
    SELECT u.id,
           CASE WHEN c.c_custkey IS NOT NULL THEN {sql_sanitize("' ' || c.c_name || ' <b>'", 255)} ELSE u.name END AS name,
           CASE WHEN c.c_custkey IS NOT NULL
                THEN {sql_sanitize("'''555-' || CAST(c.c_custkey AS VARCHAR) || ''''", 255)} ELSE u.phone END AS phone,
           CASE WHEN c.c_custkey IS NOT NULL THEN '' ELSE u.address END AS address
    FROM s_customers u LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c
      ON c.c_custkey = u.id""", "s_customers"))
def q_profile_apply(spark, root):
    shop = DriverShop(spark, root)
    return changes.apply_profiles(shop.customers, _profile_changes(shop)).select("id", "name", "phone", "address")


# --- I10: view counters ---------------------------------------------------------------------

@register("view_counters", "I10", with_ctes(f"""
    SELECT p.id, p.views + COALESCE(v.n, 0) AS views FROM s_products p LEFT JOIN (
        SELECT TRY_CAST(NULLIF(regexp_extract(path, '{DRIVER_ID_PATTERN}', 1), '') AS BIGINT) AS product_id,
               COUNT(*) AS n
        FROM (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        WHERE NOT starts_with(path, '/api') AND NOT contains(path, '.')
        GROUP BY 1) v ON v.product_id = p.id""", "s_products"))
def q_view_counters(spark, root):
    from ..operators.behavior import page_view_rows

    shop = DriverShop(spark, root)
    reads = page_view_rows(shop.request_log, id_pattern=DRIVER_ID_PATTERN)
    return changes.apply_view_counts(shop.products(), reads).select("id", "views")


# --- I6, I7: product upsert and deletes ---------------------------------------------------------

def _product_changes(shop: DriverShop):
    p = shop.owned_products()
    owner_edit = p.where(F.col("stock") >= 46).select(
        F.col("id").alias("product_id"), F.col("artisan_id").alias("requester_id"),
        F.concat(F.col("name"), F.lit(" (restocked)")).alias("name"),
        F.col("description"),
        F.concat((F.col("stock") * 7).cast("string"), F.lit(".50")).alias("price"),
        F.lit("").alias("bulk_price"), F.lit(None).cast("string").alias("min_bulk_qty"),
        F.col("category"), F.lit("80").alias("stock"), F.lit(None).cast("string").alias("image_url"),
        (F.col("id") * 4).alias("seq"),
    )
    stranger_edit = p.where(F.col("stock") == 1).select(
        F.col("id").alias("product_id"), (F.col("artisan_id") + 1).alias("requester_id"),
        F.lit("taken over").alias("name"), F.lit(None).cast("string").alias("description"),
        F.lit("1").alias("price"), F.lit(None).cast("string").alias("bulk_price"),
        F.lit(None).cast("string").alias("min_bulk_qty"), F.col("category"),
        F.lit(None).cast("string").alias("stock"), F.lit(None).cast("string").alias("image_url"),
        (F.col("id") * 4 + 1).alias("seq"),
    )
    a = shop.artisans
    creates = a.select(
        F.lit(None).cast("bigint").alias("product_id"), F.col("id").alias("requester_id"),
        F.concat(F.col("name"), F.lit(" special")).alias("name"), F.lit("new line").alias("description"),
        F.lit("99.90").alias("price"), F.lit("80").alias("bulk_price"), F.lit("5").alias("min_bulk_qty"),
        F.lit("PROMO").alias("category"), F.lit(None).cast("string").alias("stock"),
        F.lit(None).cast("string").alias("image_url"),
        (F.lit(1_000_000_000) + F.col("id")).alias("seq"),
    )
    return owner_edit.unionByName(stranger_edit).unionByName(creates)


@register("product_upsert", "I6 H12 H13", with_ctes("""
    SELECT p.id, CASE WHEN e.id IS NOT NULL THEN {SAN_NAME} ELSE p.name END AS name,
           CAST(CASE WHEN e.id IS NOT NULL THEN CAST(CAST(p.stock * 7 AS VARCHAR) || '.50' AS DECIMAL(18,2))
                     ELSE p.price END AS DOUBLE) AS price,
           CAST(CASE WHEN e.id IS NOT NULL THEN NULL ELSE p.bulk_price END AS DOUBLE) AS bulk_price,
           p.min_bulk_qty, p.category, p.artisan_id,
           CASE WHEN e.id IS NOT NULL THEN 80 ELSE p.stock END AS stock, p.created_at
    FROM s_products_owned p LEFT JOIN (SELECT id FROM s_products_owned WHERE stock >= 46) e ON e.id = p.id
    UNION ALL
    SELECT (SELECT MAX(id) FROM s_products_owned) + 1 + a.id - (SELECT MIN(id) FROM s_artisans), a.name || ' special', 99.90, 80.0, 5,
           'PROMO', a.id, 100, TIMESTAMP '{AS_OF}'
    FROM s_artisans a""".replace("{AS_OF}", AS_OF).replace("{SAN_NAME}", sql_sanitize("p.name || ' (restocked)'", 500)),
    "s_products_owned", "s_artisans"))
def q_product_upsert(spark, root):
    shop = DriverShop(spark, root)
    principals = shop.artisans.select(F.col("id").alias("user_id"), "role")
    new, _ = changes.upsert_products(shop.owned_products(), _product_changes(shop), principals, _as_of())
    return new.select("id", "name", F.col("price").cast("double").alias("price"),
                      F.col("bulk_price").cast("double").alias("bulk_price"), "min_bulk_qty", "category",
                      "artisan_id", "stock", "created_at")


@register("product_upsert_rejected", "I6", with_ctes("""
    SELECT id * 4 + 1 AS seq, id AS product_id, artisan_id + 1 AS requester_id,
           CASE WHEN artisan_id + 1 IN (SELECT id FROM s_artisans) THEN 'not_owner'
                ELSE 'not_permitted' END AS reason
    FROM s_products_owned WHERE stock = 1""", "s_products_owned", "s_artisans"))
def q_product_upsert_rejected(spark, root):
    shop = DriverShop(spark, root)
    principals = shop.artisans.select(F.col("id").alias("user_id"), "role")
    _, rejected = changes.upsert_products(shop.owned_products(), _product_changes(shop), principals, _as_of())
    return rejected


def _delete_requests(shop: DriverShop):
    p = shop.owned_products()
    mine = p.where(F.col("stock") == 50).select("id", F.col("artisan_id").alias("requester_id"))
    theirs = p.where(F.col("stock") == 49).select("id", (F.col("artisan_id") + 1).alias("requester_id"))
    return mine.unionByName(theirs)


@register("entity_delete", "I7", with_ctes("""
    SELECT id, name FROM s_products_owned WHERE stock != 50""", "s_products_owned"))
def q_entity_delete(spark, root):
    shop = DriverShop(spark, root)
    principals = shop.artisans.select(F.col("id").alias("user_id"), "role")
    kept, _ = changes.delete_rows(shop.owned_products(), _delete_requests(shop), principals)
    return kept.select("id", "name")


@register("entity_delete_rejected", "I7", with_ctes("""
    SELECT id, artisan_id + 1 AS requester_id,
           CASE WHEN artisan_id + 1 IN (SELECT id FROM s_artisans) THEN 'not_owner'
                ELSE 'not_permitted' END AS reason
    FROM s_products_owned WHERE stock = 49""", "s_products_owned", "s_artisans"))
def q_entity_delete_rejected(spark, root):
    shop = DriverShop(spark, root)
    principals = shop.artisans.select(F.col("id").alias("user_id"), "role")
    _, rejected = changes.delete_rows(shop.owned_products(), _delete_requests(shop), principals)
    return rejected


# Accounts are deleted by the administrator of their nation: suppliers with a
# balance under 2,000.  Customers in debt ask to delete themselves, and so does
# every administrator; neither may.
def _user_deletion(shop: DriverShop):
    users = shop.customers.unionByName(shop.artisans).unionByName(shop.admins)
    s = shop.table("supplier").where(F.col("s_acctbal") < 2000)
    closed = s.select((F.lit(ARTISAN_BASE) + F.col("s_suppkey")).alias("id"),
                      (F.lit(ADMIN_BASE) + F.col("s_nationkey")).alias("requester_id"))
    c = shop.table("customer").where(F.col("c_acctbal") < 0)
    own = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("requester_id"))
    admins = shop.admins.select("id", F.col("id").alias("requester_id"))
    principals = users.select(F.col("id").alias("user_id"), "role")
    return changes.delete_rows(users, closed.unionByName(own).unionByName(admins), principals,
                               owner_col=None, admin_only=True)


@register("user_delete", "I7", with_ctes(f"""
    SELECT id, name, role FROM s_customers
    UNION ALL SELECT id, name, role FROM s_artisans WHERE id NOT IN (
        SELECT {ARTISAN_BASE} + s_suppkey FROM supplier WHERE s_acctbal < 2000 AND s_nationkey IS NOT NULL)
    UNION ALL SELECT id, name, role FROM s_admins""", "s_customers", "s_artisans", "s_admins"))
def q_user_delete(spark, root):
    kept, _ = _user_deletion(DriverShop(spark, root))
    return kept.select("id", "name", "role")


@register("user_delete_rejected", "I7", with_ctes("""
    SELECT c_custkey AS id, c_custkey AS requester_id, 'not_permitted' AS reason FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT id, id, 'own_account' FROM s_admins""", "s_admins"))
def q_user_delete_rejected(spark, root):
    _, rejected = _user_deletion(DriverShop(spark, root))
    return rejected


@register("related_after_deletions", "C7 E3 F3 I7", with_ctes(f"""
    , kept AS (
        SELECT p.id, p.category, a.name FROM s_products_owned p JOIN s_artisans a ON a.id = p.artisan_id
        WHERE a.id NOT IN (
            SELECT {ARTISAN_BASE} + s_suppkey FROM supplier WHERE s_acctbal < 2000 AND s_nationkey IS NOT NULL))
    SELECT product_id, related_id, CAST(position AS INTEGER) AS position, artisan_name FROM (
      SELECT a.id AS product_id, b.id AS related_id, b.name AS artisan_name,
             ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY b.id) AS position
      FROM kept a JOIN kept b ON a.category = b.category AND a.id != b.id)
    WHERE position <= 4""", "s_products_owned", "s_artisans"))
def q_related_after_deletions(spark, root):
    from ..operators.catalog import related_products

    shop = DriverShop(spark, root)
    kept, _ = _user_deletion(shop)
    return related_products(shop.owned_products(), k=4, users=kept)


# --- I8: registration ------------------------------------------------------------------------------

def _registrations(shop: DriverShop):
    d = shop.table("documents")
    role = F.when(F.col("lang") == "en", F.lit("customer")).when(F.col("lang") == "de", F.lit("artisan")) \
        .otherwise(F.lit("admin"))
    return d.select(
        F.col("source").alias("name"),
        first_at_token(F.col("text")).alias("email"),
        role.alias("role"),
        F.lit(None).cast("string").alias("phone"),
        F.col("lang").alias("address"),
        F.col("doc_id").alias("seq"),
    )


CTES["s_registrations"] = ((), r"""
        SELECT source AS name, regexp_extract(text, '\S*@\S*', 0) AS email,
               CASE WHEN lang = 'en' THEN 'customer' WHEN lang = 'de' THEN 'artisan' ELSE 'admin' END AS role,
               CAST(NULL AS VARCHAR) AS phone, lang AS address, doc_id AS seq
        FROM documents""")


@register("registration_intake", "I8 H2", with_ctes(f"""
    SELECT (SELECT MAX(id) FROM (SELECT id FROM s_customers UNION ALL SELECT id FROM s_artisans)) + 1 + seq
               - (SELECT MIN(seq) FROM s_registrations) AS id,
           {sql_sanitize('name', 255)} AS name, em AS email, role,
           {sql_sanitize("COALESCE(phone, '')", 255)} AS phone,
           {sql_sanitize("COALESCE(address, '')", 255)} AS address, TIMESTAMP '{AS_OF}' AS created_at, seq
    FROM (SELECT *, {sql_sanitize('email', 255)} AS em,
                 MIN(seq) OVER (PARTITION BY {sql_sanitize('email', 255)}) AS first_seq
          FROM s_registrations
          WHERE NOT ({sql_falsy('name')} OR {sql_falsy('email')} OR {sql_falsy('role')})
            AND role IN ('customer', 'artisan') AND {sql_email_ok('email')})
    WHERE seq = first_seq
      AND em NOT IN (SELECT email FROM s_customers UNION ALL SELECT email FROM s_artisans)""",
    "s_registrations", "s_customers", "s_artisans"))
def q_registration_intake(spark, root):
    shop = DriverShop(spark, root)
    accepted, _ = changes.intake_users(
        _registrations(shop), shop.customers.unionByName(shop.artisans), _as_of())
    return accepted


@register("registration_rejected", "I8", with_ctes(f"""
    SELECT seq, reason FROM (
        SELECT seq, CASE
            WHEN shape IS NOT NULL THEN shape
            WHEN em IN (SELECT email FROM s_customers UNION ALL SELECT email FROM s_artisans)
                OR seq != min(seq) FILTER (WHERE shape IS NULL) OVER (PARTITION BY em) THEN 'email_taken' END AS reason
        FROM (SELECT *, {sql_sanitize('email', 255)} AS em, CASE
                WHEN {sql_falsy('name')} OR {sql_falsy('email')} OR {sql_falsy('role')} THEN 'missing_fields'
                WHEN role NOT IN ('customer', 'artisan') THEN 'role_not_allowed'
                WHEN NOT {sql_email_ok('email')} THEN 'bad_email' END AS shape
              FROM s_registrations))
    WHERE reason IS NOT NULL""", "s_registrations", "s_customers", "s_artisans"))
def q_registration_rejected(spark, root):
    shop = DriverShop(spark, root)
    _, rejected = changes.intake_users(_registrations(shop), shop.customers.unionByName(shop.artisans))
    return rejected


# --- I1: order intake (sequential rule; checked against a loop in tests) ---------------------------------

def _replay_carts(shop: DriverShop):
    o = shop.orders
    # Dealt to orders first: lines of an order lie apart, so lists made before the shuffle would not be shorter.
    items = shop.order_items.select("order_id", "product_id", "quantity").repartition("order_id")
    carts = items.groupBy("order_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("product_id").alias("productId"), F.col("quantity")))).alias("items"))
    return o.join(carts, o.id == carts.order_id, "left").select(
        F.col("id").alias("cart_id"), F.col("id").alias("seq"), "customer_id", "items",
        F.lit(None).cast("string").alias("shipping_address"), F.lit(None).cast("string").alias("payment_method"),
    )


# The rule in rounds, as a recursive statement: per product, what accepted and
# undecided earlier carts take; per cart, short on a line or safe on all.
_INTAKE = """,
cart_lines AS (
    SELECT o.id AS cart_id, o.customer_id, i.product_id, i.quantity, p.price,
           COALESCE(p.stock, 0) AS stock,
           row_number() OVER (PARTITION BY o.id ORDER BY i.product_id, i.quantity) - 1 AS pos,
           CASE WHEN p.id IS NULL THEN 'unknown_product:' || CAST(i.product_id AS VARCHAR)
                WHEN COALESCE(i.quantity, 0) <= 0 THEN 'bad_quantity:' || CAST(i.product_id AS VARCHAR) END AS bad
    FROM s_orders o JOIN s_items i ON i.order_id = o.id LEFT JOIN s_products p ON p.id = i.product_id),
bad_carts AS (SELECT cart_id, arg_min(bad, pos) AS reason FROM cart_lines WHERE bad IS NOT NULL GROUP BY cart_id),
wanted AS (
    SELECT cart_id, product_id, sum(quantity) AS q, max(quantity) AS m, any_value(stock) AS stock
    FROM cart_lines WHERE cart_id NOT IN (SELECT cart_id FROM bad_carts) GROUP BY cart_id, product_id),
st AS (
    SELECT 0 AS round, cart_id, product_id, q, m, stock, CAST(NULL AS VARCHAR) AS d FROM wanted
    UNION ALL
    SELECT round + 1, cart_id, product_id, q, m, stock,
           COALESCE(d, CASE WHEN bool_or(stock - taken < m) OVER c THEN 'R'
                            WHEN bool_and(stock - maybe >= m) OVER c THEN 'A' END)
    FROM (
        SELECT *, COALESCE(sum(CASE WHEN d = 'A' THEN q ELSE 0 END) OVER p, 0) AS taken,
               COALESCE(sum(CASE WHEN d = 'R' THEN 0 ELSE q END) OVER p, 0) AS maybe,
               bool_or(d IS NULL) OVER () AS unsettled
        FROM st
        WINDOW p AS (PARTITION BY product_id ORDER BY cart_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE unsettled
    WINDOW c AS (PARTITION BY cart_id)),
settled AS (
    SELECT *, COALESCE(sum(CASE WHEN d = 'A' THEN q ELSE 0 END) OVER (
               PARTITION BY product_id ORDER BY cart_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
    FROM st WHERE round = (SELECT max(round) FROM st)),
taken_lines AS (
    SELECT l.*, s.d, s.taken FROM cart_lines l JOIN settled s ON l.cart_id = s.cart_id AND l.product_id = s.product_id),
shorts AS (
    SELECT cart_id, arg_min('out_of_stock:' || CAST(product_id AS VARCHAR), pos) AS reason
    FROM taken_lines WHERE d = 'R' AND stock - taken < quantity GROUP BY cart_id),
totals AS (SELECT cart_id, sum(price * quantity) AS total FROM taken_lines WHERE d = 'A' GROUP BY cart_id)
"""
def _intake_sql(body: str) -> str:
    return with_ctes(_INTAKE + body, "s_orders", "s_items", "s_products", "s_cart_actions").replace("WITH ", "WITH RECURSIVE ", 1)


def _intake(spark, root):
    shop = DriverShop(spark, root)
    # The new rows join the tables that hold the order history already.
    line_key = F.col("order_id") * LINES_OF_AN_ORDER + F.col("line_number")
    last_ids = {"orders": shop.orders.select(F.max("id")).scalar(),
                "order_items": shop.order_items.select(F.max(line_key)).scalar(),
                "cart_actions": shop.cart_actions.select(F.max("id")).scalar()}
    return changes.intake_orders(_replay_carts(shop), shop.products(), as_of=_as_of(), last_ids=last_ids)


@register("order_intake", "I1", _intake_sql("""
    SELECT o.id AS cart_id, t.total IS NOT NULL AS accepted,
           CASE WHEN t.total IS NULL THEN COALESCE(b.reason, s.reason, 'empty_cart') END AS reason,
           CAST(t.total AS DOUBLE) AS total_amount
    FROM s_orders o LEFT JOIN totals t ON t.cart_id = o.id
    LEFT JOIN bad_carts b ON b.cart_id = o.id LEFT JOIN shorts s ON s.cart_id = o.id"""))
def q_order_intake(spark, root):
    return _intake(spark, root).decisions.select(
        "cart_id", "accepted", "reason", F.col("total_amount").cast("double").alias("total_amount"))


@register("intake_new_orders", "I1", _intake_sql(f"""
    SELECT (SELECT MAX(id) FROM s_orders) + row_number() OVER (ORDER BY o.id) AS id,
           o.customer_id, CAST(t.total AS DOUBLE) AS total_amount, 'confirmed' AS status,
           'mock_payment' AS payment_method, '' AS shipping_address, TIMESTAMP '{AS_OF}' AS created_at
    FROM s_orders o JOIN totals t ON t.cart_id = o.id"""))
def q_intake_new_orders(spark, root):
    return _intake(spark, root).orders.withColumn(
        "total_amount", F.col("total_amount").cast("double")).drop("seq", "cart_id")


@register("intake_new_lines", "I1", _intake_sql("""
    SELECT (SELECT MAX(order_id * {per_order} + line_number) FROM s_items)
               + row_number() OVER (ORDER BY l.cart_id, l.pos) AS id, n.order_id, l.product_id,
           CAST(l.quantity AS BIGINT) AS quantity, CAST(l.price AS DOUBLE) AS price
    FROM taken_lines l JOIN (
        SELECT cart_id, (SELECT MAX(id) FROM s_orders) + row_number() OVER (ORDER BY cart_id) AS order_id
        FROM totals) n ON n.cart_id = l.cart_id
    WHERE l.d = 'A'""".format(per_order=LINES_OF_AN_ORDER)))
def q_intake_new_lines(spark, root):
    return _intake(spark, root).items.select(
        "id", "order_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"),
        F.col("price").cast("double").alias("price"))


@register("intake_stock", "I1", _intake_sql("""
    SELECT p.id AS product_id, CAST(p.stock - COALESCE(u.used, 0) AS BIGINT) AS stock
    FROM s_products p LEFT JOIN (
        SELECT product_id, sum(quantity) AS used FROM taken_lines WHERE d = 'A' GROUP BY product_id) u
      ON u.product_id = p.id"""))
def q_intake_stock(spark, root):
    return _intake(spark, root).products.select(
        F.col("id").alias("product_id"), F.col("stock").cast("bigint").alias("stock"))


@register("intake_events", "I1", _intake_sql(f"""
    SELECT (SELECT MAX(id) FROM s_cart_actions) + row_number() OVER (ORDER BY cart_id, pos) AS id,
           CAST(cart_id AS VARCHAR) AS session_id, customer_id AS user_id,
           product_id, 'checkout' AS action, CAST(quantity AS BIGINT) AS quantity,
           TIMESTAMP '{AS_OF}' AS created_at
    FROM taken_lines WHERE d = 'A'"""))
def q_intake_events(spark, root):
    return _intake(spark, root).cart_events.select(
        "id", "session_id", "user_id", "product_id", "action",
        F.col("quantity").cast("bigint").alias("quantity"), "created_at")


# --- C8, D19, D20: carts -----------------------------------------------------------------------

def _validated_carts(shop: DriverShop):
    adds = shop.cart_actions.where(F.col("action") == "add").select(
        F.col("user_id").alias("cart_id"), "product_id", "quantity")
    return changes.validate_carts(changes.merge_cart_adds(adds), shop.products())


@register("cart_validation", "C8 D20 H15", with_ctes("""
    SELECT c.cart_id, p.id AS productId, p.name, CAST(p.price AS DOUBLE) AS price, p.image_url,
           CASE WHEN c.quantity IS NULL OR p.stock IS NULL THEN NULL ELSE LEAST(c.quantity, p.stock) END AS quantity,
           p.stock AS availableStock
    FROM (SELECT user_id AS cart_id, product_id, CAST(SUM(quantity) AS BIGINT) AS quantity
          FROM s_cart_actions WHERE action = 'add' GROUP BY 1, 2) c
    JOIN s_products p ON p.id = c.product_id""", "s_cart_actions", "s_products"))
def q_cart_validation(spark, root):
    return _validated_carts(DriverShop(spark, root)).drop("_price_exact")


@register("cart_totals", "D19", with_ctes("""
    SELECT c.cart_id, CAST(SUM(p.price * LEAST(c.quantity, p.stock)) AS DOUBLE) AS total,
           CAST(SUM(LEAST(c.quantity, p.stock)) AS BIGINT) AS item_count
    FROM (SELECT user_id AS cart_id, product_id, CAST(SUM(quantity) AS BIGINT) AS quantity
          FROM s_cart_actions WHERE action = 'add' GROUP BY 1, 2) c
    JOIN s_products p ON p.id = c.product_id GROUP BY c.cart_id""", "s_cart_actions", "s_products"))
def q_cart_totals(spark, root):
    return changes.cart_totals(_validated_carts(DriverShop(spark, root)))


def _cart_bodies(shop: DriverShop):
    """Request bodies of checkouts as text: one cart per purchase event; without
    a product the body breaks off, as a request cut short would."""
    e = shop.cart_actions.where(F.col("action") == "checkout")
    product = F.col("product_id").cast("string")
    body = F.concat(F.lit('[{"productId": '), product, F.lit(', "quantity": '),
                    F.col("quantity").cast("string"), F.lit('}, {"productId": 1}]'))
    return e.select(F.col("id").alias("cart_id"), F.coalesce(body, F.lit('[{"productId": ')).alias("body"))


@register("cart_bodies", "H19", with_ctes("""
    SELECT id AS cart_id, product_id IS NOT NULL AS readable, unnest(CASE WHEN product_id IS NULL THEN [0] ELSE [0, 1] END) AS pos,
           unnest(CASE WHEN product_id IS NULL THEN [CAST(NULL AS BIGINT)] ELSE [product_id, 1] END) AS product_id,
           unnest(CASE WHEN product_id IS NULL THEN [CAST(NULL AS INTEGER)] ELSE [quantity, NULL] END) AS quantity
    FROM s_cart_actions WHERE action = 'checkout'""", "s_cart_actions"))
def q_cart_bodies(spark, root):
    """Carts that arrive as JSON text, as the lines that intake takes."""
    carts = changes.cart_requests_from_json(_cart_bodies(DriverShop(spark, root)))
    lines = carts.select("cart_id", F.col("items").isNotNull().alias("readable"),
                         F.posexplode_outer("items").alias("pos", "item"))
    return lines.select("cart_id", "readable", F.coalesce("pos", F.lit(0)).alias("pos"),
                        F.col("item.productId").alias("product_id"), F.col("item.quantity").alias("quantity"))


# --- C9, I12: quality -------------------------------------------------------------------------------

@register("referential_orphans", "C9", with_ctes("""
    SELECT 'line_without_order' AS check_name, order_id AS key FROM s_items
      WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT id FROM s_orders WHERE id IS NOT NULL)
    UNION ALL SELECT 'line_without_product', product_id FROM s_items
      WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM s_products WHERE id IS NOT NULL)
    UNION ALL SELECT 'order_without_customer', id FROM s_orders
      WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM s_customers WHERE id IS NOT NULL)
    UNION ALL SELECT 'order_without_lines', id FROM s_orders
      WHERE id NOT IN (SELECT order_id FROM s_items WHERE order_id IS NOT NULL)""",
    "s_items", "s_orders", "s_products", "s_customers"))
def q_referential_orphans(spark, root):
    shop = DriverShop(spark, root)
    return quality.referential_orphans(shop.orders, shop.order_items, shop.products(), shop.customers)


def _audit_tables(shop: DriverShop) -> dict:
    return {
        "users": shop.customers.unionByName(shop.artisans),
        "products": shop.owned_products(),
        "orders": shop.orders,
        "order_items": shop.order_items.withColumn("id", F.col("order_id") * LINES_OF_AN_ORDER + F.col("line_number")),
        "b2b_enquiries": _enquiries(shop),
        "page_views": shop.page_views,
        "cart_actions": shop.cart_actions,
    }


CTES["s_keyed_items"] = (("s_items",), f"""
        SELECT *, order_id * {LINES_OF_AN_ORDER} + line_number AS id FROM s_items""")
CTES["s_users"] = (("s_customers", "s_artisans"), """
        SELECT * FROM s_customers UNION ALL SELECT * FROM s_artisans""")
_AUDIT_SQL_TABLES = {
    "users": "s_users", "products": "s_products_owned", "orders": "s_orders",
    "order_items": "s_keyed_items", "b2b_enquiries": "s_enquiries", "page_views": "s_page_views",
    "cart_actions": "s_cart_actions",
}


def _audit_sql() -> str:
    parts = []
    for t, r in quality.SHOP_RULES.items():
        v = _AUDIT_SQL_TABLES[t]
        for c in r.not_null:
            parts.append(f"SELECT '{t}' AS table_name, 'not_null:{c}' AS rule, "
                         f"COUNT(*) FILTER (WHERE {c} IS NULL) AS violations FROM {v}")
        for c, allowed in r.checks.items():
            vals = ", ".join(f"'{a}'" for a in allowed)
            parts.append(f"SELECT '{t}', 'check:{c}', COUNT(*) FILTER (WHERE {c} NOT IN ({vals})) FROM {v}")
        for c in r.unique:
            parts.append(f"SELECT '{t}', 'unique:{c}', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM "
                         f"(SELECT COUNT(*) AS n FROM {v} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1)")
        for c, (pt, pc) in r.foreign.items():
            pv = _AUDIT_SQL_TABLES[pt]
            parts.append(f"SELECT '{t}', 'foreign:{c}->{pt}.{pc}', COUNT(*) FROM {v} "
                         f"WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {pc} FROM {pv} WHERE {pc} IS NOT NULL)")
    return with_ctes("\nUNION ALL ".join(parts), *_AUDIT_SQL_TABLES.values())


@register("constraint_audit", "I12", _audit_sql())
def q_constraint_audit(spark, root):
    return quality.constraint_audit(_audit_tables(DriverShop(spark, root)))


# --- D9: KPIs ----------------------------------------------------------------------------------------

@register("shop_kpis", "D9", with_ctes("""
    SELECT (SELECT COUNT(*) FROM s_customers) + (SELECT COUNT(*) FROM s_artisans) AS total_users,
           (SELECT COUNT(*) FROM s_customers) AS total_customers,
           (SELECT COUNT(*) FROM s_artisans) AS total_artisans,
           (SELECT COUNT(*) FROM part) AS total_products,
           (SELECT COUNT(*) FROM s_orders) AS total_orders,
           (SELECT CAST(COALESCE(SUM(total_amount) FILTER (WHERE status != 'cancelled'), 0) AS DOUBLE)
              FROM s_orders) AS total_revenue,
           (SELECT COUNT(*) FROM s_enquiries WHERE status = 'pending') AS pending_b2b,
           (SELECT COUNT(*) FROM s_page_views) AS total_page_views""",
    "s_customers", "s_artisans", "s_orders", "s_enquiries", "s_page_views"))
def q_shop_kpis(spark, root):
    shop = DriverShop(spark, root)
    return kpis.shop_kpis(shop.customers.unionByName(shop.artisans), shop.products(), shop.orders,
                          _enquiries(shop), shop.page_views)


# --- 2.12 extension: bulk quotes on the merged cart lines ------------------------------------

@register("bulk_quotes", "2.12 bulk pricing B8", with_ctes("""
    SELECT c.cart_id, c.product_id, c.quantity,
           CAST(CASE WHEN COALESCE(p.bulk_price, 0) != 0 AND c.quantity >= p.min_bulk_qty
                     THEN p.bulk_price ELSE p.price END AS DOUBLE) AS unit_price,
           CAST(CASE WHEN COALESCE(p.bulk_price, 0) != 0 AND c.quantity >= p.min_bulk_qty
                     THEN p.bulk_price ELSE p.price END * c.quantity AS DOUBLE) AS line_amount
    FROM (SELECT user_id AS cart_id, product_id, CAST(SUM(quantity) AS BIGINT) AS quantity
          FROM s_cart_actions WHERE action = 'add' GROUP BY 1, 2) c
    JOIN s_products p ON p.id = c.product_id""", "s_cart_actions", "s_products"))
def q_bulk_quotes(spark, root):
    from ..operators.catalog import bulk_quote

    shop = DriverShop(spark, root)
    adds = shop.cart_actions.where(F.col("action") == "add").select(
        F.col("user_id").alias("cart_id"), "product_id", "quantity")
    return bulk_quote(changes.merge_cart_adds(adds), shop.products())
