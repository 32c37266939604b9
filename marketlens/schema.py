"""Fixed schemas: the seven shop tables, derived inputs and the driver tables.

Money is ``decimal(18,2)`` inside operators so that sums do not depend on the
order rows arrive in; results are cast to double at the edge.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


L, I, S, D, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampType()

# --- shop tables (credential column left out of users) ----------------------
USERS = _s(
    ("id", L, False), ("name", S, False), ("email", S, False), ("role", S, False),
    ("phone", S, True), ("address", S, True), ("created_at", TS, True),
)
PRODUCTS = _s(
    ("id", L, False), ("name", S, False), ("description", S, True),
    ("price", MONEY, False), ("bulk_price", MONEY, True), ("min_bulk_qty", I, True),
    ("category", S, False), ("artisan_id", L, False), ("image_url", S, True),
    ("stock", I, True), ("views", L, True), ("created_at", TS, True),
)
ORDERS = _s(
    ("id", L, False), ("customer_id", L, False), ("total_amount", MONEY, False),
    ("status", S, True), ("payment_method", S, True), ("shipping_address", S, True),
    ("created_at", TS, True),
)
ORDER_ITEMS = _s(
    ("id", L, False), ("order_id", L, False), ("product_id", L, False),
    ("quantity", I, False), ("price", MONEY, False),
)
ENQUIRIES = _s(
    ("id", L, False), ("company_name", S, False), ("contact_person", S, False),
    ("email", S, False), ("phone", S, True), ("product_category", S, True),
    ("quantity", L, True), ("message", S, True), ("status", S, True),
    ("created_at", TS, True),
)
PAGE_VIEWS = _s(
    ("id", L, False), ("session_id", S, True), ("user_id", L, True),
    ("page", S, False), ("product_id", L, True), ("created_at", TS, True),
)
CART_ACTIONS = _s(
    ("id", L, False), ("session_id", S, True), ("user_id", L, True),
    ("product_id", L, False), ("action", S, True), ("quantity", I, True),
    ("created_at", TS, True),
)

SHOP_TABLES = {
    "users": USERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "b2b_enquiries": ENQUIRIES,
    "page_views": PAGE_VIEWS,
    "cart_actions": CART_ACTIONS,
}

# --- derived inputs ----------------------------------------------------------
# The export's column order.
SALES_CSV_COLUMNS = [
    "order_id", "customer", "email", "total_amount", "status",
    "created_at", "product", "category", "quantity", "price",
]
SALES_CSV = _s(*[(c, S, True) for c in SALES_CSV_COLUMNS])

# The enquiry export's column order.
ENQUIRY_CSV_COLUMNS = [
    "id", "company_name", "contact_person", "email", "phone",
    "product_category", "quantity", "message", "status", "created_at",
]

CART_ITEM = T.StructType([
    T.StructField("productId", L, True), T.StructField("quantity", I, True),
])
CART_REQUESTS = _s(
    ("cart_id", L, False), ("seq", L, False), ("customer_id", L, True),
    ("items", T.ArrayType(CART_ITEM), True), ("shipping_address", S, True),
    ("payment_method", S, True),
)
REQUEST_LOG = _s(
    ("ts", TS, True), ("method", S, True), ("path", S, True),
    ("session_id", S, True), ("user_id", L, True),
)
STATUS_CHANGES = _s(("id", L, True), ("status", S, True), ("seq", L, False))
CANCEL_REQUESTS = _s(("order_id", L, True), ("requester_id", L, True), ("seq", L, False))
PRINCIPALS = _s(("user_id", L, False), ("role", S, False))

# --- driver tables -----------------------------------------------------------
NTZ = T.TimestampNTZType()
DRIVER_TABLES = {
    "region": _s(("r_regionkey", I, True), ("r_name", S, True)),
    "nation": _s(("n_nationkey", I, True), ("n_name", S, True), ("n_regionkey", I, True)),
    "customer": _s(
        ("c_custkey", L, True), ("c_name", S, True), ("c_nationkey", I, True),
        ("c_acctbal", D, True), ("c_mktsegment", S, True),
    ),
    "supplier": _s(
        ("s_suppkey", L, True), ("s_name", S, True), ("s_nationkey", I, True),
        ("s_acctbal", D, True),
    ),
    "part": _s(
        ("p_partkey", L, True), ("p_name", S, True), ("p_brand", S, True),
        ("p_type", S, True), ("p_size", I, True), ("p_retailprice", D, True),
    ),
    "orders": _s(
        ("o_orderkey", L, True), ("o_custkey", L, True), ("o_orderstatus", S, True),
        ("o_totalprice", D, True), ("o_orderdate", NTZ, True), ("o_orderpriority", S, True),
    ),
    "lineitem": _s(
        ("l_orderkey", L, True), ("l_partkey", L, True), ("l_suppkey", L, True),
        ("l_linenumber", I, True), ("l_quantity", D, True), ("l_extendedprice", D, True),
        ("l_discount", D, True), ("l_tax", D, True), ("l_returnflag", S, True),
        ("l_linestatus", S, True), ("l_shipdate", NTZ, True),
    ),
    "events": _s(
        ("event_id", L, True), ("ts", NTZ, True), ("user_id", L, True),
        ("event_type", S, True), ("value", D, True), ("props", S, True),
    ),
    "documents": _s(
        ("doc_id", L, True), ("text", S, True), ("lang", S, True),
        ("source", S, True), ("n_chars", L, True),
    ),
    "pages": _s(("page_id", L, True), ("url", S, True), ("html", S, True)),
}
