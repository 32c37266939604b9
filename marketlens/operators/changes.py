"""Change batches: validate requested changes and apply them to a snapshot.

The reference changes one row per request.  Here a DataFrame of requests
and a snapshot go in; a new snapshot and the rejected requests (with a
reason) come out.  Plain Parquet has no MERGE, so an apply is "last request
per key" (a partial ``max_by`` aggregate) joined onto the snapshot; counters
are aggregated deltas joined onto it.  Callers write the new snapshot to a
new folder, never over the one being read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double, clamp_to_stock, js_or, parse_float_js, parse_int_js
from ..functions.text import ENQUIRY_TEXT_MAX, PRODUCT_TEXT_MAX, USER_TEXT_MAX, email_ok, sanitize
from ..session import checkpoint_dir, materialize, release
from .windows import RangeRanked, last_per_key, seq_bounds, sum_before

# Allowed states, defaults and roles.
ORDER_STATUSES = ["pending", "confirmed", "shipped", "delivered", "cancelled"]
ENQUIRY_STATUSES = ["pending", "reviewed", "accepted", "rejected"]
CANCELLABLE = ["pending", "confirmed"]
SELF_SERVICE_ROLES = ["customer", "artisan"]
PRODUCT_EDITOR_ROLES = ["artisan", "admin"]
DEFAULT_MIN_BULK_QTY = 10
DEFAULT_STOCK = 100
DEFAULT_IMAGE_URL = "/frontend/images/placeholder.jpg"
DEFAULT_PAYMENT = "mock_payment"
NEW_ORDER_STATUS = "confirmed"
NEW_ENQUIRY_STATUS = "pending"


def _created(as_of: Column | None) -> Column:
    """Creation time of new rows: the time of the run, or what the caller states."""
    return (F.current_timestamp() if as_of is None else as_of).cast("timestamp_ntz")


def _replace(df: DataFrame, updates: dict[str, Column]) -> DataFrame:
    """Project ``df`` keeping its column order and types, with some columns
    replaced, so a new snapshot has exactly the old one's schema."""
    types = dict(df.dtypes)
    return df.select(*[updates[c].cast(types[c]).alias(c) if c in updates else F.col(c) for c in df.columns])


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# --- I3, I4: status changes ----------------------------------------------------

def apply_status(df: DataFrame, changes: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Set ``status`` by id; the last valid change per id wins.

    Any transition is allowed; an unknown id is a no-op, as an UPDATE of no
    row is.  Changes with a status outside ``allowed`` are rejected.
    """
    ok = F.coalesce(F.col("status").isin(*allowed), F.lit(False))
    rejected = changes.where(~ok).withColumn("reason", F.lit("status_not_allowed"))
    last = last_per_key(changes.where(ok).select("id", "status", "seq"), "id", "seq")
    merged = df.join(last.select("id", F.col("status").alias("_new_status")), "id", "left")
    new = _replace(merged, {"status": F.coalesce(F.col("_new_status"), F.col("status"))})
    return new.select(*df.columns), rejected


# --- D21 + I2: cancellation ------------------------------------------------------

def cancel_orders(requests: DataFrame, orders: DataFrame, items: DataFrame,
                  products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customer cancellations -> (orders, products, rejected).

    A request needs an existing order, owned by the requester, in a
    cancellable state.  Of several valid requests for one order (in ``seq``
    order) the first cancels it and the later ones see a cancelled order.
    The order's units go back to stock.
    """
    o = orders.select(F.col("id").alias("order_id"), F.col("customer_id").alias("_owner"),
                      F.col("status").alias("_status"))
    r = requests.join(o, "order_id", "left")
    reason = (
        F.when(F.col("_owner").isNull(), F.lit("unknown_order"))
        .when(~F.col("requester_id").eqNullSafe(F.col("_owner")), F.lit("not_permitted"))
        .when(~F.coalesce(F.col("_status").isin(*CANCELLABLE), F.lit(False)),
              F.concat(F.lit("not_cancellable:"), F.coalesce(F.col("_status"), F.lit("null"))))
    )
    # Written once: the three results below all start from it.
    r = materialize(r.withColumn("reason", reason), "cancellations")
    winners = r.where(F.col("reason").isNull()).groupBy("order_id").agg(F.min("seq").alias("_win"))
    labeled = r.join(winners, "order_id", "left").withColumn(
        "reason",
        F.coalesce(F.col("reason"),
                   F.when(F.col("seq") != F.col("_win"), F.lit("not_cancellable:cancelled"))),
    )
    rejected = labeled.where(F.col("reason").isNotNull()).select(*requests.columns, "reason")
    cancelled = winners.select(F.col("order_id").alias("id"), F.lit(True).alias("_cancel"))
    new_orders = _replace(
        orders.join(cancelled, "id", "left"),
        {"status": F.when(F.col("_cancel"), F.lit("cancelled")).otherwise(F.col("status"))},
    ).select(*orders.columns)
    units = (
        items.join(winners.select("order_id"), "order_id", "left_semi")
        .groupBy("product_id").agg(F.sum("quantity").alias("_back"))
    )
    new_products = _replace(
        products.join(units, products.id == units.product_id, "left"),
        {"stock": F.col("stock") + F.coalesce(F.col("_back"), F.lit(0))},
    ).select(*products.columns)
    return new_orders, new_products, rejected


# --- I1: order intake --------------------------------------------------------------

@dataclass
class IntakeResult:
    """What order intake decided.  Decisions and rows for the orders, lines and
    cart events tables are made when asked for; ids follow the largest ids those
    tables hold (``last_ids``) without gaps, in the order of carts and places."""

    products: DataFrame    # products with stock taken off
    open_lines: list[int]  # undecided contended lines at the start of each round, then 0
    accepted_carts: DataFrame  # columns of an order without id, cart_id, seq
    accepted_lines: DataFrame  # cart_id, seq, pos, product_id, quantity, price
    last_ids: dict[str, Column | int]
    _headers: DataFrame        # one row per cart
    _stopped: DataFrame        # cart_id, reason of carts that no stock was asked for
    _short: DataFrame          # cart_id, pos, product_id of lines above the whole stock
    _tried: DataFrame          # lines whose carts may be short on them, and accepted lines
    _cuts: Callable[[DataFrame], list[int] | None]
    _bucket_width: int | None

    @functools.cached_property
    def decisions(self) -> DataFrame:
        """cart_id, seq, accepted, reason, total_amount.  With every decision
        final, ``taken`` is the stock used, so the reasons are exact.  Lines that
        even the whole stock used leaves enough for are never short."""
        used = self.accepted_lines.groupBy("product_id").agg(F.sum("quantity").alias("_used"))
        scarce = self._tried.join(used, "product_id").where(
            F.col("decision") | (F.col("stock") - F.col("_used") < F.col("quantity"))).drop("_used")
        taken = sum_before(
            scarce, "product_id", "seq",
            {"taken": F.when(F.col("decision"), F.col("quantity")).otherwise(F.lit(0)).cast("bigint")},
            self._bucket_width, self._cuts(self._tried))
        late = taken.where(~F.col("decision") & (F.col("stock") - F.col("taken") < F.col("quantity")))
        missing = self._short.unionByName(late.select("cart_id", "pos", "product_id"))
        judged = (
            missing.select("cart_id", F.struct("pos", "product_id").alias("_miss"))
            .unionByName(self.accepted_lines.select("cart_id", (F.col("price") * F.col("quantity")).alias("_amount")),
                         allowMissingColumns=True)
            .groupBy("cart_id").agg(F.min("_miss").alias("_miss"), F.sum("_amount").alias("total_amount"))
            .select("cart_id", F.concat(F.lit("out_of_stock:"), F.col("_miss.product_id").cast("string")).alias("reason"),
                    "total_amount"))
        outcome = judged.unionByName(self._stopped, allowMissingColumns=True)
        return self._headers.select("cart_id", "seq").join(outcome, "cart_id", "left").select(
            "cart_id", "seq", F.col("total_amount").isNotNull().alias("accepted"), "reason", "total_amount")

    def _next_id(self, table: str) -> Column:
        last = self.last_ids.get(table, 0)
        return F.coalesce(last if isinstance(last, Column) else F.lit(last), F.lit(0)) + 1 + F.col("_rank")

    @functools.cached_property
    def orders(self) -> DataFrame:
        """New orders."""
        ranked = RangeRanked(self.accepted_carts, ["seq", "cart_id"], "intake-orders").ranked("_rank")
        return ranked.select(self._next_id("orders").alias("id"), *self.accepted_carts.columns)

    @functools.cached_property
    def _lines(self) -> DataFrame:
        carts = self.orders.select("cart_id", F.col("id").alias("order_id"), "customer_id", "created_at")
        return RangeRanked(self.accepted_lines.join(carts, "cart_id"), ["seq", "cart_id", "pos"],
                           "intake-lines").ranked("_rank")

    @property
    def items(self) -> DataFrame:
        """New order lines with the price of the day."""
        return self._lines.select(self._next_id("order_items").alias("id"), "order_id", "product_id",
                                  "quantity", "price")

    @property
    def cart_events(self) -> DataFrame:
        """One checkout action per accepted line."""
        return self._lines.select(
            self._next_id("cart_actions").alias("id"), F.col("cart_id").cast("string").alias("session_id"),
            F.col("customer_id").alias("user_id"), "product_id", F.lit("checkout").alias("action"),
            "quantity", "created_at")


def _cart_lines(carts: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Explode carts to lines joined to products, once.

    Returns (cart headers, lines to try, pre-rejected carts).  The exploded
    lines are written to the shared checkpoint folder once, so the rounds and
    the outputs reuse them.  The carts are read where they lie: their items once,
    for the lines (which stay with their cart where products are broadcast), and
    the headers, without the items, by the outputs that need them.

    Stock only falls, so a cart with a line above a product's whole stock is
    refused whatever the others do.  ``_short_at`` is the place of its first such
    line (else NULL); lines after it decide nothing and are not written.
    """
    headers = carts.select("cart_id", "seq", "customer_id", "shipping_address", "payment_method")
    p = products.select(F.col("id").alias("product_id"), "price",
                        F.coalesce(F.col("stock"), F.lit(0)).cast("bigint").alias("stock"),
                        F.lit(True).alias("_known"))
    pid = F.coalesce(F.col("product_id").cast("string"), F.lit("null"))
    bad = (
        F.when(F.col("pos").isNull(), F.lit("empty_cart"))
        .when(F.col("_known").isNull(), F.concat(F.lit("unknown_product:"), pid))
        .when(F.coalesce(F.col("quantity"), F.lit(0)) <= 0,
              F.concat(F.lit("bad_quantity:"), pid))
    )
    usable = F.when(F.size(F.filter("items", lambda i: i.isNotNull())) > 0, F.col("items"))
    cart = Window.partitionBy("cart_id")
    lines = materialize(
        carts.where(F.col("cart_id").isNotNull())
        .select("cart_id", "seq", F.posexplode_outer(usable).alias("pos", "item"))
        .where(F.col("item").isNotNull() | F.col("pos").isNull())
        .select("cart_id", "seq", "pos", F.col("item.productId").alias("product_id"),
                F.col("item.quantity").alias("quantity"))
        .join(p, "product_id", "left")
        .withColumn("_bad", bad)
        .select("*", F.bool_or(F.col("_bad").isNotNull()).over(cart).alias("_stop"),
                F.min(F.when(F.col("_bad").isNotNull(), F.col("pos"))).over(cart).alias("_bad_at"),
                F.min(F.when(F.col("quantity") > F.col("stock"), F.col("pos"))).over(cart).alias("_short_at"))
        .where(F.when(F.col("_stop"), F.col("_bad").isNotNull()
                      & (F.col("pos").isNull() | (F.col("pos") == F.col("_bad_at"))))
               .otherwise(F.col("_short_at").isNull() | (F.col("pos") <= F.col("_short_at"))))
        .drop("_known", "_stop", "_bad_at"),
        "intake-exploded",
    )
    stopped = lines.where(F.col("_bad").isNotNull())
    first_bad = stopped.where(F.col("pos").isNotNull()).groupBy("cart_id").agg(F.min("_bad").alias("reason"))
    empty = stopped.where(F.col("pos").isNull()).select("cart_id", F.col("_bad").alias("reason"))
    return headers, lines.where(F.col("_bad").isNull()).drop("_bad"), first_bad.unionByName(empty)


def _contended(lines: DataFrame) -> DataFrame:
    """Lines of products that an undecided cart wants and whose demand
    (accepted and undecided lines) exceeds the stock."""
    wanted = lines.groupBy("product_id").agg(
        F.sum("qty_sum").alias("_demand"), F.bool_or(~F.col("accepted")).alias("_open"), F.max("stock").alias("_stock"))
    scarce = wanted.where(F.col("_open") & (F.col("_demand") > F.col("_stock"))).select("product_id")
    return lines.join(scarce, "product_id", "left_semi")


def _written(lines: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The lines as a table, with the numbers of undecided lines and of all
    lines in play (counted while they are written)."""
    if "refused" not in lines.columns:
        lines = lines.withColumn("refused", F.lit(False))
    seen = Observation()
    left = F.coalesce(~F.col("refused"), F.lit(True))
    out = materialize(lines.observe(
        seen, F.count_if(left & ~F.col("accepted")).alias("open"), F.count_if(left).alias("all")), name)
    return out, (seen.get["open"], seen.get["all"])


def _cuts(lines: DataFrame, bucket_rows: int, rows: int | None = None) -> list[int]:
    """Cut points of ``seq``, about ``bucket_rows`` lines apart, if some product has more lines than that."""
    if rows is not None and rows <= bucket_rows:
        return []
    sizes = lines.groupBy("product_id").count().agg(F.max("count").alias("hottest"), F.sum("count").alias("rows")).first()
    if (sizes.hottest or 0) <= bucket_rows:
        return []
    return seq_bounds(lines, "seq", -(-sizes.rows // bucket_rows))


def intake_orders(carts: DataFrame, products: DataFrame, bucket_rows: int = 1 << 20,
                  bucket_width: int | None = None, as_of: Column | None = None,
                  last_ids: dict[str, Column | int] | None = None) -> IntakeResult:
    """Place many orders at once with the reference's sequential stock rule.

    Carts are taken in ``seq`` order.  A cart is refused when it has no usable
    line, names an unknown product, has a non-positive quantity (a deliberate
    tightening), or when some line asks for more than the product's stock
    left after the earlier accepted carts.  Each line is checked alone, all
    are deducted; the total uses the table price.

    Lines above the whole stock come first: their carts are refused while the
    lines are written and ask for nothing.  Contention comes next: a product whose
    remaining demand fits its stock is never short, so its lines leave, and a
    cart without other lines is accepted.

    Acceptance is sequential, so what is left is decided in rounds.  Per product
    and earlier carts: ``taken`` sums accepted carts, ``maybe`` sums accepted
    and undecided ones.  A cart is surely accepted when ``stock - maybe`` is
    enough on every line, surely refused when ``stock - taken`` is short on
    one.  The earliest undecided cart is always decided, so every round makes
    progress; there is no cap on rounds, whose number follows the longest
    chain of carts that compete for the same stock.

    A round writes one table: the lines still in play and those of carts it
    refused.  The next round starts from those not refused, without products
    that are contended no more (none undecided, or what is left of the demand
    fits), so it costs what is still open: one shuffle by product, one by cart.
    Where a product has more than ``bucket_rows`` lines, running sums are taken in
    ranges of ``seq`` of about that many (or of ``bucket_width``), so a
    product that every cart wants is no single task.

    ``last_ids``: the largest id of the tables ``orders``, ``order_items`` and
    ``cart_actions`` that the new rows will join (a number or a scalar column;
    0 where left out or NULL).
    """
    spark = carts.sparkSession
    checkpoint_dir(spark)
    headers, tried, pre_rejected = _cart_lines(carts, products)
    hopeful = tried.where(F.col("_short_at").isNull()).drop("_short_at")
    lines = hopeful.groupBy("cart_id", "seq", "product_id").agg(
        F.sum("quantity").alias("qty_sum"), F.max("quantity").alias("qty_max"), F.min("stock").alias("stock"),
    ).withColumn("accepted", F.lit(False))
    open_c = ~F.col("accepted")
    cart = Window.partitionBy("cart_id")
    state, rows = _written(_contended(lines), "intake-lines")
    states, open_lines = [state], [rows[0]]
    bounds = None
    while open_lines[-1]:
        active = state.where(~F.col("refused")).drop("refused")
        if len(states) > 1:
            active = _contended(active)
        if bucket_width is None:
            bounds = _cuts(active, bucket_rows, rows[1])
        sums = sum_before(
            active, "product_id", "seq",
            {"taken": F.when(F.col("accepted"), F.col("qty_sum")).otherwise(F.lit(0)),
             "maybe": F.col("qty_sum")},
            bucket_width, bounds,
        )
        judged = (
            sums.withColumn("_ok", F.bool_and(F.col("stock") - F.col("maybe") >= F.col("qty_max")).over(cart))
            .withColumn("_short", F.bool_or(F.col("stock") - F.col("taken") < F.col("qty_max")).over(cart))
            .withColumn("refused", open_c & F.col("_short"))
            .withColumn("accepted", F.col("accepted") | (F.col("_ok") & ~F.col("_short")))
            .drop("_ok", "_short", "taken", "maybe"))
        state, rows = _written(judged, "intake-round")
        states.append(state)
        open_lines.append(rows[0])
        if open_lines[-1] >= open_lines[-2]:
            raise RuntimeError("order intake made no progress")
    refused = functools.reduce(DataFrame.unionByName, states).where("refused").select("cart_id").distinct()
    settled = materialize(
        hopeful.join(refused.withColumn("_refused", F.lit(True)), "cart_id", "left")
        .withColumn("decision", F.col("_refused").isNull()).drop("_refused"), "intake-final-lines")
    release(*states)
    acc_lines = settled.where("decision")
    created = _created(as_of)
    totals = acc_lines.groupBy("cart_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("total_amount"))
    new_orders = (
        headers.join(totals, "cart_id")
        .select(
            "customer_id", "total_amount",
            F.lit(NEW_ORDER_STATUS).alias("status"),
            js_or(F.col("payment_method"), DEFAULT_PAYMENT, text=True).alias("payment_method"),
            F.coalesce(F.col("shipping_address"), F.lit("")).alias("shipping_address"),
            created.alias("created_at"), "seq", "cart_id",
        )
    )
    used = acc_lines.groupBy("product_id").agg(F.sum("quantity").alias("_used"))
    new_products = _replace(
        products.join(used, products.id == used.product_id, "left"),
        {"stock": F.col("stock") - F.coalesce(F.col("_used"), F.lit(0))},
    ).select(*products.columns)
    above = F.col("pos") == F.col("_short_at")
    return IntakeResult(
        new_products, open_lines, new_orders,
        acc_lines.select("cart_id", "seq", "pos", "product_id", "quantity", "price"), last_ids or {},
        headers, pre_rejected, tried.where(above & (F.col("quantity") > F.col("stock"))).select("cart_id", "pos", "product_id"),
        tried.where(~above).drop("_short_at").withColumn("decision", F.lit(False)).unionByName(settled),
        lambda df: _cuts(df, bucket_rows) if bucket_width is None else None, bucket_width)


# --- I5: enquiry intake --------------------------------------------------------------

def intake_enquiries(raw: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Wholesale enquiries -> (accepted rows, rejected rows).

    Company, contact and email are required; the email shape is tested on
    the raw text, before sanitising; every text field is sanitised to 1000
    characters; quantity is ``parseInt``-ed when given, else NULL.  ``as_of``
    (a column of ``raw`` or a constant) is the time of creation, else now.
    """
    missing = (js_or(_text("company_name"), None, text=True).isNull()
               | js_or(_text("contact_person"), None, text=True).isNull()
               | js_or(_text("email"), None, text=True).isNull())
    reason = (F.when(missing, F.lit("missing_fields"))
              .when(~email_ok(_text("email")), F.lit("bad_email")))
    tagged = raw.withColumn("reason", reason)
    n = ENQUIRY_TEXT_MAX
    qty = js_or(_text("quantity"), None, text=True)
    accepted = tagged.where(F.col("reason").isNull()).select(
        "id",
        sanitize(_text("company_name"), n).alias("company_name"),
        sanitize(_text("contact_person"), n).alias("contact_person"),
        sanitize(_text("email"), n).alias("email"),
        sanitize(F.coalesce(_text("phone"), F.lit("")), n).alias("phone"),
        sanitize(F.coalesce(_text("product_category"), F.lit("")), n).alias("product_category"),
        F.when(qty.isNotNull(), parse_int_js(qty)).alias("quantity"),
        sanitize(F.coalesce(_text("message"), F.lit("")), n).alias("message"),
        F.lit(NEW_ENQUIRY_STATUS).alias("status"),
        _created(as_of).alias("created_at"),
    )
    rejected = tagged.where(F.col("reason").isNotNull()).select("id", "reason")
    return accepted, rejected


# --- I8: registration ----------------------------------------------------------------

def intake_users(raw: DataFrame, users: DataFrame, as_of: Column | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """Registrations -> (accepted users, rejected rows) (I8).

    Name, email and role are required; role must be customer or artisan;
    the email must have the right shape; the sanitised email must be new to
    the table and to the batch (the first by ``seq`` wins; case-sensitive).
    New ids follow the table's largest id in the order of ``seq``, the batch's
    smallest ``seq`` coming first.
    """
    n = USER_TEXT_MAX
    missing = (js_or(_text("name"), None, text=True).isNull()
               | js_or(_text("email"), None, text=True).isNull()
               | js_or(_text("role"), None, text=True).isNull())
    shape = (F.when(missing, F.lit("missing_fields"))
             .when(~F.coalesce(_text("role").isin(*SELF_SERVICE_ROLES), F.lit(False)), F.lit("role_not_allowed"))
             .when(~email_ok(_text("email")), F.lit("bad_email")))
    tagged = raw.withColumn("_email", sanitize(_text("email"), n)).withColumn("reason", shape)
    existing = users.select(F.col("email").alias("_email"), F.lit(True).alias("_taken")).distinct()
    ok = tagged.where(F.col("reason").isNull())
    firsts = ok.groupBy("_email").agg(F.min("seq").alias("_first"))
    judged = (
        ok.join(existing, "_email", "left").join(firsts, "_email")
        .withColumn("reason", F.when(F.col("_taken") | (F.col("seq") != F.col("_first")),
                                     F.lit("email_taken")))
    )
    max_id = users.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    min_seq = raw.select(F.coalesce(F.min("seq"), F.lit(0))).scalar()
    accepted = judged.where(F.col("reason").isNull()).select(
        (max_id + 1 + F.col("seq") - min_seq).alias("id"),
        sanitize(_text("name"), n).alias("name"),
        F.col("_email").alias("email"),
        _text("role").alias("role"),
        sanitize(F.coalesce(_text("phone"), F.lit("")), n).alias("phone"),
        sanitize(F.coalesce(_text("address"), F.lit("")), n).alias("address"),
        _created(as_of).alias("created_at"),
        "seq",
    )
    rejected = (
        tagged.where(F.col("reason").isNotNull()).select("seq", "reason")
        .unionByName(judged.where(F.col("reason").isNotNull()).select("seq", "reason"))
    )
    return accepted, rejected


# --- I9: profiles --------------------------------------------------------------------

def apply_profiles(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace name, phone and address with sanitised values; last change wins."""
    n = USER_TEXT_MAX
    last = last_per_key(changes.select(F.col("user_id").alias("id"), "name", "phone", "address", "seq"), "id", "seq")
    new = last.select(
        "id",
        sanitize(_text("name"), n).alias("_name"),
        sanitize(F.coalesce(_text("phone"), F.lit("")), n).alias("_phone"),
        sanitize(F.coalesce(_text("address"), F.lit("")), n).alias("_address"),
        F.lit(True).alias("_hit"),
    )
    merged = users.join(new, "id", "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))
    return _replace(merged, {c: pick(c) for c in ("name", "phone", "address")}).select(*users.columns)


# --- I10: view counters -----------------------------------------------------------------

def apply_view_counts(products: DataFrame, view_events: DataFrame) -> DataFrame:
    """``views + 1`` per detail read, as aggregated deltas."""
    delta = view_events.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    merged = products.join(delta, products.id == delta.product_id, "left")
    return _replace(merged, {"views": F.coalesce(F.col("views"), F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0))}
                    ).select(*products.columns)


# --- I6, I7: product upsert and deletes ---------------------------------------------------

def upsert_products(products: DataFrame, changes: DataFrame, principals: DataFrame,
                    as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Create or edit products -> (products, rejected).

    ``changes``: seq, product_id (NULL = create), requester_id and the form
    fields as text.  Only artisans and admins may change products; an
    artisan only their own.  A create needs name, price and category and
    takes the reference's defaults; an edit replaces every field, the last
    edit per product wins.  New ids follow the largest id in the order of
    ``seq``, the smallest ``seq`` of the creates coming first; ``as_of`` is
    their time of creation, else now.
    """
    n = PRODUCT_TEXT_MAX
    who = principals.select(F.col("user_id").alias("requester_id"), F.col("role").alias("_role"))
    owners = products.select(F.col("id").alias("product_id"), F.col("artisan_id").alias("_owner"),
                             F.col("image_url").alias("_old_image"), F.lit(True).alias("_exists"))
    c = changes.join(who, "requester_id", "left").join(owners, "product_id", "left")

    def bad_count(name: str) -> Column:
        given = js_or(_text(name), None, text=True)
        return given.isNotNull() & parse_int_js(given).try_cast("int").isNull()

    is_create = F.col("product_id").isNull()
    price = parse_float_js(_text("price"))
    bulk = js_or(_text("bulk_price"), None, text=True)
    reason = (
        F.when(~F.coalesce(F.col("_role").isin(*PRODUCT_EDITOR_ROLES), F.lit(False)), F.lit("not_permitted"))
        .when(is_create & (js_or(_text("name"), None, text=True).isNull()
                           | js_or(_text("price"), None, text=True).isNull()
                           | js_or(_text("category"), None, text=True).isNull()),
              F.lit("missing_fields"))
        .when(~is_create & F.col("_exists").isNull(), F.lit("unknown_product"))
        .when(~is_create & (F.col("_role") == "artisan") & ~F.col("_owner").eqNullSafe(F.col("requester_id")),
              F.lit("not_owner"))
        .when(price.try_cast("decimal(18,2)").isNull(), F.lit("bad_price"))
        .when(bulk.isNotNull() & parse_float_js(bulk).try_cast("decimal(18,2)").isNull(), F.lit("bad_bulk_price"))
        .when(bad_count("min_bulk_qty"), F.lit("bad_min_bulk_qty"))
        .when(bad_count("stock"), F.lit("bad_stock"))
    )
    c = c.withColumn("reason", reason)
    fields = [
        sanitize(_text("name"), n).alias("name"),
        sanitize(F.coalesce(_text("description"), F.lit("")), n).alias("description"),
        price.try_cast("decimal(18,2)").alias("price"),
        F.when(bulk.isNotNull(), parse_float_js(bulk)).try_cast("decimal(18,2)").alias("bulk_price"),
        sanitize(_text("category"), n).alias("category"),
    ]
    ok = c.where(F.col("reason").isNull())
    max_id = products.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    min_seq = changes.where(F.col("product_id").isNull()).select(F.coalesce(F.min("seq"), F.lit(0))).scalar()
    created = ok.where(is_create).select(
        (max_id + 1 + F.col("seq") - min_seq).alias("id"), *fields,
        F.coalesce(parse_int_js(js_or(_text("min_bulk_qty"), None, text=True)),
                   F.lit(DEFAULT_MIN_BULK_QTY)).alias("min_bulk_qty"),
        F.col("requester_id").alias("artisan_id"),
        sanitize(js_or(_text("image_url"), DEFAULT_IMAGE_URL, text=True), n).alias("image_url"),
        F.coalesce(parse_int_js(js_or(_text("stock"), None, text=True)), F.lit(DEFAULT_STOCK)).alias("stock"),
        F.lit(0).cast("bigint").alias("views"),
        _created(as_of).alias("created_at"),
    )
    edits = last_per_key(
        ok.where(~is_create).select(
            F.col("product_id").alias("id"), *fields,
            parse_int_js(js_or(_text("min_bulk_qty"), F.lit(str(DEFAULT_MIN_BULK_QTY)), text=True)).alias("min_bulk_qty"),
            sanitize(js_or(_text("image_url"), F.col("_old_image"), text=True), n).alias("image_url"),
            parse_int_js(js_or(_text("stock"), F.lit(str(DEFAULT_STOCK)), text=True)).alias("stock"),
            "seq",
        ),
        "id", "seq",
    )
    edit_cols = ["name", "description", "price", "bulk_price", "min_bulk_qty", "category", "stock", "image_url"]
    merged = products.join(
        edits.select("id", *[F.col(x).alias(f"_e_{x}") for x in edit_cols], F.lit(True).alias("_edited")),
        "id", "left",
    )
    updated = _replace(
        merged, {x: F.when(F.col("_edited"), F.col(f"_e_{x}")).otherwise(F.col(x)) for x in edit_cols}
    ).select(*products.columns)
    new_rows = created.select(*[
        (F.col(x) if x in created.columns else F.lit(None)).cast(products.schema[x].dataType).alias(x)
        for x in products.columns
    ])
    rejected = c.where(F.col("reason").isNotNull()).select("seq", "product_id", "requester_id", "reason")
    return updated.unionByName(new_rows), rejected


def delete_rows(df: DataFrame, requests: DataFrame, principals: DataFrame,
                owner_col: str | None = "artisan_id", admin_only: bool = False
                ) -> tuple[DataFrame, DataFrame]:
    """Delete by id with the reference's permission rules.

    Products: artisans delete their own, admins any.  Users
    (``admin_only=True``, ``owner_col=None``): admins only, never themselves.
    """
    who = principals.select(F.col("user_id").alias("requester_id"), F.col("role").alias("_role"))
    target = df.select(F.col("id"), *( [F.col(owner_col).alias("_owner")] if owner_col else []),
                       F.lit(True).alias("_exists"))
    r = requests.join(who, "requester_id", "left").join(target, "id", "left")
    roles = ["admin"] if admin_only else PRODUCT_EDITOR_ROLES
    reason = F.when(~F.coalesce(F.col("_role").isin(*roles), F.lit(False)), F.lit("not_permitted"))
    if admin_only:
        reason = reason.when(F.col("id") == F.col("requester_id"), F.lit("own_account"))
    else:
        reason = reason.when(F.col("_exists").isNull(), F.lit("unknown_id")).when(
            (F.col("_role") == "artisan") & ~F.col("_owner").eqNullSafe(F.col("requester_id")),
            F.lit("not_owner"))
    r = r.withColumn("reason", reason)
    gone = r.where(F.col("reason").isNull()).select("id").distinct()
    rejected = r.where(F.col("reason").isNotNull()).select("id", "requester_id", "reason")
    return df.join(gone, "id", "left_anti"), rejected


# --- H19: cart request bodies ---------------------------------------------------------------

CART_BODY_SCHEMA = "array<struct<productId:bigint,quantity:int>>"


def parse_cart_body(body: Column) -> Column:
    """JSON cart body (``[{"productId": 1, "quantity": 2}, ...]``) -> array of
    structs; malformed text gives NULL, which intake treats as an empty cart (H19)."""
    return F.from_json(body, CART_BODY_SCHEMA)


def cart_requests_from_json(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """Cart requests whose items arrive as JSON text, typed for :func:`intake_orders`."""
    return raw.withColumn("items", parse_cart_body(F.col(body_col))).drop(body_col)


# --- C8, D19, D20: carts ---------------------------------------------------------------------

def merge_cart_adds(adds: DataFrame) -> DataFrame:
    """Repeated adds of one product in one cart become one line."""
    return adds.groupBy("cart_id", "product_id").agg(F.sum("quantity").cast("bigint").alias("quantity"))


def validate_carts(cart_lines: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines checked against the catalogue.

    Unknown products drop out; the quantity is clamped to the stock (a NULL
    on either side stays NULL rather than becoming the other value).
    """
    p = products.select(F.col("id").alias("product_id"), "name", "price", "image_url", "stock")
    return cart_lines.join(p, "product_id").select(
        "cart_id",
        F.col("product_id").alias("productId"),
        "name",
        as_double(F.col("price")).alias("price"),
        "image_url",
        clamp_to_stock(F.col("quantity"), F.col("stock")).alias("quantity"),
        F.col("stock").alias("availableStock"),
        F.col("price").alias("_price_exact"),
    )


def cart_totals(validated: DataFrame) -> DataFrame:
    """Σ price × quantity and Σ quantity per cart."""
    return validated.groupBy("cart_id").agg(
        as_double(F.sum(F.col("_price_exact") * F.col("quantity"))).alias("total"),
        F.sum("quantity").cast("bigint").alias("item_count"),
    )
