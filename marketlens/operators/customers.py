"""Customer operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double, cents_of, cents_to_money

# The columns of a user that may be shown (never credentials).
USER_PUBLIC_COLUMNS = ["id", "name", "email", "role", "phone", "address", "created_at"]
ADMIN = "admin"


def user_directory(users: DataFrame) -> DataFrame:
    """Users without credential columns, newest first."""
    return users.select(*USER_PUBLIC_COLUMNS).orderBy(F.col("created_at").desc(), F.col("id").desc())


def newest_first(df: DataFrame, condition=None) -> DataFrame:
    """Optional filter, then newest first with an id tie-break."""
    out = df.where(condition) if condition is not None else df
    return out.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())


def visible_rows(df: DataFrame, owner_col: str, user_id: int, role: str) -> DataFrame:
    """Rows one session may see: an admin sees all, others their own."""
    if role == ADMIN:
        return df
    return df.where(F.col(owner_col) == F.lit(user_id))


def owned_rows(df: DataFrame, owner_col: str, principals: DataFrame) -> DataFrame:
    """Batch form of B5 for non-admin principals: each row paired with the
    principal that owns it (an equi-join, no pairs beyond ownership).

    An admin sees every row; pairing admins with all rows would only copy the
    table, so an admin among the principals is an error.  :func:`session_scopes`
    takes principals of any role, :func:`visible_rows` one session.
    """
    viewer = F.when(F.col("role") == ADMIN, F.raise_error(F.lit("an admin owns no rows: use session_scopes")))
    p = principals.select(viewer.otherwise(F.col("user_id")).alias("viewer_id"))
    return df.join(p, df[owner_col] == p.viewer_id)


def session_scopes(df: DataFrame, owner_col: str, principals: DataFrame) -> DataFrame:
    """What each principal may see of ``df`` (B5): scope ``all`` for admins and
    ``own`` for others, with the number of visible rows.

    Rows are counted per owner before the join; the count of all rows is a
    scalar, so no row is paired with an admin.
    """
    own = df.groupBy(F.col(owner_col).alias("user_id")).agg(F.count(F.lit(1)).alias("_own"))
    everything = df.select(F.count(F.lit(1))).scalar()
    is_admin = F.col("role") == ADMIN
    return principals.join(own, "user_id", "left").select(
        F.col("user_id").alias("viewer_id"), "role",
        F.when(is_admin, F.lit("all")).otherwise(F.lit("own")).alias("scope"),
        F.when(is_admin, everything).otherwise(F.coalesce("_own", F.lit(0))).alias("visible_rows"),
    )


def orders_with_customer(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders with the customer's name and email; orders of a deleted user drop out."""
    u = users.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                     F.col("email").alias("customer_email"))
    return orders.join(u, "customer_id").select(
        "id", "customer_id", as_double(F.col("total_amount")).alias("total_amount"), "status",
        "created_at", "customer_name", "customer_email",
    )


def repeat_customers(orders: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Customers with more than one order: count and lifetime value, top k.

    Orders are counted per customer first (map-side partial aggregate), so
    the join sees one row per customer; cancelled orders count.
    """
    per = (
        orders.groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum(cents_of(orders, "total_amount")).alias("ltv"))
        .where(F.col("order_count") > 1)
    )
    u = users.select(F.col("id").alias("customer_id"), "name", "email")
    return (
        per.join(u, "customer_id")
        .orderBy(F.col("order_count").desc(), F.col("customer_id").asc())
        .limit(k)
        .select(F.col("customer_id").alias("id"), "name", "email", "order_count",
                as_double(cents_to_money(F.col("ltv"))).alias("lifetime_value"))
    )
