"""Shop tables derived from the driver's TPC-H-like tables.

The driver's data has no shop schema, so every shop concept is a projection
of a driver table (see the README's adapter table).  All frames are lazy and
read only the columns a query asks for; the matching DuckDB definitions live
in :mod:`marketlens.plans.oracle` and must stay in step with these.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import money, source_cents
from ..functions.text import first_at_token, url_path
from ..schema import DRIVER_TABLES
from ..session import materialize, stored_files
from .tables import read_table

# Driver order status -> shop order status.
ORDER_STATUS = {"P": "cancelled", "O": "confirmed", "F": "delivered"}
# Driver event type -> shop cart action.
CART_EVENT_ACTION = {"click": "add", "purchase": "checkout"}
VIEW_EVENT = "view"
PRODUCT_PAGE_PREFIX = "/products/"
# Suppliers become artisans in an id range of their own, above all customers.
ARTISAN_BASE = 10**12
# Regional administrators, one per nation, in a range above the artisans.
ADMIN_BASE = 2 * 10**12
# The business date the driver's order history ends on.
AS_OF = "2001-08-01"

# (session, folder, files) -> products table written there.
_SNAPSHOTS: dict[tuple, DataFrame] = {}


def _event_product(props) -> "F.Column":
    return F.get_json_object(props, "$.k").try_cast("bigint")


def views_from_events(events: DataFrame) -> DataFrame:
    """Product page views from 'view' events (batch or stream)."""
    e = events.where(F.col("event_type") == VIEW_EVENT)
    pid = _event_product(F.col("props"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("user_id"),
        F.concat(F.lit(PRODUCT_PAGE_PREFIX), pid.cast("string")).alias("page"),
        pid.alias("product_id"),
        F.col("ts").alias("created_at"),
    )


def cart_from_events(events: DataFrame) -> DataFrame:
    """Cart actions from click (add) and purchase (checkout) events (batch or stream)."""
    e = events.where(F.col("event_type").isin(*CART_EVENT_ACTION))
    action = F.when(F.lit(False), F.lit(None))
    for etype, name in CART_EVENT_ACTION.items():
        action = action.when(F.col("event_type") == etype, F.lit(name))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("user_id"),
        _event_product(F.col("props")).alias("product_id"),
        action.alias("action"),
        F.lit(1).alias("quantity"),
        F.col("ts").alias("created_at"),
    )


def requests_from_pages(pages: DataFrame) -> DataFrame:
    """Browser requests: one GET per crawled page URL (batch or stream)."""
    return pages.select(
        F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit("GET").alias("method"),
        url_path(F.col("url")).alias("path"),
        F.col("page_id").cast("string").alias("session_id"),
        F.lit(None).cast("bigint").alias("user_id"),
    )


class DriverShop:
    """Lazily built shop frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name, kind="driver")

    # --- people ------------------------------------------------------------
    def _nation_names(self) -> DataFrame:
        # 25 rows by the schema's definition; Spark broadcasts it on size.
        return self.table("nation").select(
            F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation")
        )

    @cached_property
    def customers(self) -> DataFrame:
        """Customer users: id, name, email (= customer name), role, phone, address."""
        c = self.table("customer")
        return c.join(
            self._nation_names(), c.c_nationkey == F.col("nation_key"), "left"
        ).select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_name").alias("email"),
            F.lit("customer").alias("role"),
            F.lit(None).cast("string").alias("phone"),
            F.col("nation").alias("address"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def artisans(self) -> DataFrame:
        """Artisan users from the supplier table."""
        s = self.table("supplier")
        return s.join(
            self._nation_names(), s.s_nationkey == F.col("nation_key"), "left"
        ).select(
            (F.lit(ARTISAN_BASE) + F.col("s_suppkey")).alias("id"),
            F.col("s_name").alias("name"),
            F.col("s_name").alias("email"),
            F.lit("artisan").alias("role"),
            F.lit(None).cast("string").alias("phone"),
            F.col("nation").alias("address"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def admins(self) -> DataFrame:
        """Administrators: one per nation (25 rows by the schema's definition)."""
        n = self.table("nation")
        none = F.lit(None)
        return n.select(
            (F.lit(ADMIN_BASE) + F.col("n_nationkey")).alias("id"),
            F.col("n_name").alias("name"), F.col("n_name").alias("email"), F.lit("admin").alias("role"),
            none.cast("string").alias("phone"), F.col("n_name").alias("address"),
            none.cast("timestamp_ntz").alias("created_at"),
        )

    # --- catalogue -----------------------------------------------------------
    @cached_property
    def product_views(self) -> DataFrame:
        """View counter per product: number of 'view' events naming it."""
        e = self.table("events")
        return (
            e.where(F.col("event_type") == VIEW_EVENT)
            .select(_event_product(F.col("props")).alias("product_id"))
            .groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("views"))
        )

    @cached_property
    def product_owner(self) -> DataFrame:
        """Owning artisan of a part: the lowest supplier id that shipped it; the
        part entered the shop when it was first shipped."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("product_id"))
            .agg((F.lit(ARTISAN_BASE) + F.min("l_suppkey")).alias("artisan_id"),
                 F.min("l_shipdate").alias("created_at"))
        )

    def owned_products(self) -> DataFrame:
        """The products table with owner and creation time, as a shop stores it.

        Derived from parts, lines and events once per session and state of
        these files, written to the shared checkpoint folder and read from there.
        """
        files = [f for t in ("part", "lineitem", "events") for f in stored_files(self.spark, f"{self.root}/{t}*")]
        key = (self.spark.sparkContext.applicationId, self.root, tuple(files))
        if key not in _SNAPSHOTS:
            _SNAPSHOTS[key] = materialize(self.products(with_owner=True), "products")
        return _SNAPSHOTS[key]

    def products(self, with_owner: bool = False) -> DataFrame:
        """Products from ``part``; views from events; owner only on request."""
        p = self.table("part")
        price = money(F.col("p_retailprice"))
        base = p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("description"),
            price.alias("price"),
            # Wholesale price by product line: none, zero, or 15 % off.
            F.when(F.col("p_type") == "ECONOMY", F.lit(None).cast("decimal(18,2)"))
            .when(F.col("p_type") == "SMALL", F.lit(0).cast("decimal(18,2)"))
            .otherwise(money(F.round(price * F.lit(0.85).cast("decimal(3,2)"), 2)))
            .alias("bulk_price"),
            F.lit(10).alias("min_bulk_qty"),
            F.col("p_type").alias("category"),
            F.lit(None).cast("string").alias("image_url"),
            F.col("p_size").alias("stock"),
        )
        v = self.product_views
        out = base.join(v, base.id == v.product_id, "left").select(
            *[base[c] for c in base.columns],
            F.coalesce(v.views, F.lit(0)).alias("views"),
        )
        if with_owner:
            o = self.product_owner
            out = out.join(o, out.id == o.product_id, "inner").drop("product_id")
        return out

    # --- orders ------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.table("orders")
        status = F.when(F.lit(False), F.lit(None))
        for code, name in ORDER_STATUS.items():
            status = status.when(F.col("o_orderstatus") == code, F.lit(name))
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            money(F.col("o_totalprice")).alias("total_amount"),
            source_cents(F.col("o_totalprice")).alias("total_amount_cents"),
            status.alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """Order lines; ``line_total`` carries the line's own revenue figure."""
        li = self.table("lineitem")
        qty = F.col("l_quantity").cast("int")
        # Unit price in whole cents, rounded half-up from the line total.
        cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5)
        unit_price = money(cents.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)"))
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_linenumber").alias("line_number"),
            qty.alias("quantity"),
            unit_price.alias("price"),
            money(F.col("l_extendedprice")).alias("line_total"),
            source_cents(F.col("l_extendedprice")).alias("line_total_cents"),
        )

    # --- event logs ----------------------------------------------------------
    @cached_property
    def page_views(self) -> DataFrame:
        """Product page views from 'view' events."""
        return views_from_events(self.table("events"))

    @cached_property
    def cart_actions(self) -> DataFrame:
        """Cart actions from click (add) and purchase (checkout) events."""
        return cart_from_events(self.table("events"))

    def stream(self, name: str, max_files: int | None = None) -> DataFrame:
        """A driver table read as a file stream (new files are new events)."""
        reader = self.spark.readStream.schema(DRIVER_TABLES[name])
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(f"{self.root}/{name}*.parquet")

    @cached_property
    def request_log(self) -> DataFrame:
        """Browser requests: one GET per crawled page URL."""
        return requests_from_pages(self.table("pages"))

    @cached_property
    def raw_enquiries(self) -> DataFrame:
        """Wholesale enquiry submissions, as typed into the form (all text)."""
        d = self.table("documents")
        return d.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("company_name"),
            F.col("lang").alias("contact_person"),
            first_at_token(F.col("text")).alias("email"),
            F.lit(None).cast("string").alias("phone"),
            F.col("lang").alias("product_category"),
            F.col("n_chars").cast("string").alias("quantity"),
            F.col("text").alias("message"),
        )
