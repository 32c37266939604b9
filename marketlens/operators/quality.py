"""Data-quality operators: orphans (C9) and the constraint audit.

The reference declares NOT NULL, CHECK, UNIQUE and foreign keys but does not
switch foreign-key enforcement on, so broken references can exist; here they
are reported, never silently dropped.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose non-NULL ``key`` has no parent row (C9, anti-join)."""
    p = parent.select(F.col(parent_key).alias(key))
    return child.where(F.col(key).isNotNull()).join(p, key, "left_anti")


@dataclass
class TableRules:
    """Declared constraints of one table."""
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, list[str]] = field(default_factory=dict)   # column -> allowed values
    unique: list[str] = field(default_factory=list)
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, column)


# The shop schema's declared constraints.
SHOP_RULES: dict[str, TableRules] = {
    "users": TableRules(
        not_null=["id", "name", "email", "role"],
        checks={"role": ["customer", "artisan", "admin"]},
        unique=["id", "email"],
    ),
    "products": TableRules(
        not_null=["id", "name", "price", "category", "artisan_id"],
        unique=["id"],
        foreign={"artisan_id": ("users", "id")},
    ),
    "orders": TableRules(
        not_null=["id", "customer_id", "total_amount"],
        checks={"status": ["pending", "confirmed", "shipped", "delivered", "cancelled"]},
        unique=["id"],
        foreign={"customer_id": ("users", "id")},
    ),
    "order_items": TableRules(
        not_null=["id", "order_id", "product_id", "quantity", "price"],
        unique=["id"],
        foreign={"order_id": ("orders", "id"), "product_id": ("products", "id")},
    ),
    "b2b_enquiries": TableRules(
        not_null=["id", "company_name", "contact_person", "email"],
        checks={"status": ["pending", "reviewed", "accepted", "rejected"]},
        unique=["id"],
    ),
    "page_views": TableRules(not_null=["id", "page"], unique=["id"]),
    "cart_actions": TableRules(
        not_null=["id", "product_id"],
        checks={"action": ["add", "remove", "checkout"]},
        unique=["id"],
    ),
}


WHOLE = ("tinyint", "smallint", "int", "bigint")


def _mark(rule: int, key: Column, child: int = 1, parent: int = 0) -> Column:
    """One row of a key stream: a row of the rule's table, or of the table
    that its foreign key names."""
    return F.struct(F.lit(rule).alias("rule"), key.alias("key"),
                    F.lit(child).cast("bigint").alias("child"), F.lit(parent).cast("bigint").alias("parent"))


def _key_stream(tables: dict[str, DataFrame], marks: dict[str, list[Column]]) -> DataFrame:
    """Counts of children and parents per (rule, key).

    Every table is scanned once; its marks of all rules are exploded, counted
    within each task and shuffled once, whatever the number of rules."""
    parts = [
        tables[name].select(F.explode(F.array(*columns)).alias("m")).where("m IS NOT NULL").select("m.*")
        for name, columns in marks.items() if columns]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("rule", "key").agg(
        F.sum("child").alias("child"), F.sum("parent").alias("parent"))


def constraint_audit(tables: dict[str, DataFrame],
                     rules: dict[str, TableRules] = SHOP_RULES) -> DataFrame:
    """Violation count per (table, rule).

    A CHECK passes on NULL, as in SQL.  UNIQUE counts the rows whose value
    occurs more than once; a foreign key counts child rows whose non-NULL key
    has no parent.  All rules of all tables share one stream of marks (and
    those of text keys another): NULL and CHECK violations are marks without a key, UNIQUE and foreign keys
    marks with one, and a foreign key's parents are marks of the same rule.
    """
    names: list[tuple[int, str, str, str]] = []
    # Marks by table; whole numbers and other keys are streams of their own.
    marks: dict[str, dict[str, list[Column]]] = {"bigint": {}, "string": {}}

    def rule_of(table: str, kind: str, rule: str) -> int:
        names.append((len(names), table, f"{kind}:{rule}", kind))
        return len(names) - 1

    def violation(table: str, rule: int, where: Column) -> None:
        marks["bigint"].setdefault(table, []).append(F.when(where, _mark(rule, F.lit(None).cast("bigint"))))

    def key(table: str, rule: int, column: str, kind: str, child: int = 1, parent: int = 0) -> None:
        marks[kind].setdefault(table, []).append(F.when(
            F.col(column).isNotNull(), _mark(rule, F.col(column).cast(kind), child, parent)))

    def kind_of(table: str, column: str) -> str:
        return "bigint" if dict(tables[table].dtypes)[column] in WHOLE else "string"

    for table in tables:
        r = rules.get(table)
        if r is None:
            continue
        for c in r.not_null:
            violation(table, rule_of(table, "not_null", c), F.col(c).isNull())
        for c, allowed in r.checks.items():
            violation(table, rule_of(table, "check", c), ~F.col(c).isin(*allowed))
        for c in r.unique:
            key(table, rule_of(table, "unique", c), c, kind_of(table, c))
        for c, (parent, pc) in r.foreign.items():
            if parent not in tables:
                continue
            rule = rule_of(table, "foreign", f"{c}->{parent}.{pc}")
            kind = "bigint" if kind_of(table, c) == kind_of(parent, pc) == "bigint" else "string"
            key(table, rule, c, kind)
            key(parent, rule, pc, kind, 0, 1)
    # Rules without a violation have no key to count: their names are kept here.
    known = next(iter(tables.values())).sparkSession.createDataFrame(
        names, "rule int, table_name string, name string, kind string")
    bad = (
        F.when(F.col("kind") == "unique", F.when(F.col("child") > 1, F.col("child")))
        .when(F.col("kind") == "foreign", F.when(F.col("parent") == 0, F.col("child")))
        .otherwise(F.col("child")))
    kinds = F.create_map(*[F.lit(x) for i, _, _, kind in names for x in (i, kind)])
    streams = [_key_stream(tables, m).drop("key") for m in marks.values() if m]
    counted = (
        functools.reduce(DataFrame.unionByName, streams).withColumn("kind", kinds[F.col("rule")])
        .groupBy("rule").agg(F.sum(bad).alias("n")))
    # One row a rule: broadcasting it is bounded by the rules, not the data.
    return known.join(F.broadcast(counted), "rule", "left").select(
        "table_name", F.col("name").alias("rule"), F.coalesce("n", F.lit(0)).alias("violations"))


# Rules of the key stream of ``referential_orphans``.
_LINE_ORDER, _LINE_PRODUCT, _ORDER_USER = range(3)


def referential_orphans(orders: DataFrame, items: DataFrame, products: DataFrame,
                        users: DataFrame) -> DataFrame:
    """Broken or empty references as (check, key) rows.

    Lines of missing orders or products, orders of missing users, and
    orders without any line (an existence test, not an error).  One key stream
    finds the keys that lack a parent or a child; the rows that hold such a
    key are then selected from their tables, so a missing order with any
    number of lines is never gathered in one value.
    """
    def key(column: str, rule: int, child: int, parent: int) -> Column:
        return F.when(F.col(column).isNotNull(), _mark(rule, F.col(column).cast("bigint"), child, parent))

    counts = _key_stream(
        {"items": items, "orders": orders, "products": products, "users": users},
        {"items": [key("order_id", _LINE_ORDER, 1, 0), key("product_id", _LINE_PRODUCT, 1, 0)],
         "orders": [key("id", _LINE_ORDER, 0, 1), key("customer_id", _ORDER_USER, 1, 0)],
         "products": [key("id", _LINE_PRODUCT, 0, 1)],
         "users": [key("id", _ORDER_USER, 0, 1)]})
    # Four selections start from it; they reuse its one exchange.
    broken = counts.select("rule", "key", "child", "parent")

    def lacking(rule: int, column: str) -> DataFrame:
        return broken.where((F.col("rule") == rule) & (F.col("parent") == 0)).select(F.col("key").alias(column))

    li_order = items.select("order_id").join(lacking(_LINE_ORDER, "order_id"), "order_id", "left_semi").select(
        F.lit("line_without_order").alias("check_name"), F.col("order_id").alias("key"))
    li_product = items.select("product_id").join(lacking(_LINE_PRODUCT, "product_id"), "product_id", "left_semi").select(
        F.lit("line_without_product").alias("check_name"), F.col("product_id").alias("key"))
    o_user = orders.select("id", "customer_id").join(
        lacking(_ORDER_USER, "customer_id"), "customer_id", "left_semi").select(
        F.lit("order_without_customer").alias("check_name"), F.col("id").alias("key"))
    # An id that several orders share is one key of the stream, but a row each.
    empty = broken.where((F.col("rule") == _LINE_ORDER) & (F.col("child") == 0)).select(F.col("key").alias("id"))
    o_empty = orders.select("id").join(empty, "id", "left_semi").select(
        F.lit("order_without_lines").alias("check_name"), F.col("id").alias("key"))
    return li_order.unionByName(li_product).unionByName(o_user).unionByName(o_empty)
