"""Catalogue operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double
from ..functions.text import PRODUCT_TEXT_MAX, ascii_lower, sanitize
from .customers import newest_first, owned_rows
from .windows import RangeRanked

ALL_CATEGORIES = "All"
LIKE_ESCAPE = "!"


def with_artisan(products: DataFrame, users: DataFrame, phone: bool = False) -> DataFrame:
    """products ⋈ users on the owning artisan.

    Adds ``artisan_name`` and ``artisan_location`` (and ``artisan_phone``);
    products whose artisan row is gone drop out, as with the inner join.
    """
    cols = [F.col("id").alias("artisan_id"), F.col("name").alias("artisan_name"),
            F.col("address").alias("artisan_location")]
    if phone:
        cols.append(F.col("phone").alias("artisan_phone"))
    return products.join(users.select(*cols), "artisan_id")


def search_filter(search: str, max_len: int = PRODUCT_TEXT_MAX) -> Column:
    """``name LIKE %q% OR description LIKE %q%`` with the sanitised query (B2, H5).

    The query text is sanitised as a literal column (constant-folded by
    Catalyst); ``%`` and ``_`` typed by the user stay wildcards, and the
    escape character is doubled so it only ever means itself (T1).
    """
    q = ascii_lower(sanitize(F.lit(search), max_len))
    pattern = F.concat(F.lit("%"), F.replace(q, F.lit(LIKE_ESCAPE), F.lit(LIKE_ESCAPE * 2)), F.lit("%"))
    esc = F.lit(LIKE_ESCAPE)
    return (
        F.coalesce(F.like(ascii_lower(F.col("name")), pattern, esc), F.lit(False))
        | F.coalesce(F.like(ascii_lower(F.col("description")), pattern, esc), F.lit(False))
    )


def filter_catalog(products: DataFrame, category: str | None = None,
                   search: str | None = None) -> DataFrame:
    """Optional category equality ('All' = none) and optional text search."""
    out = products
    if category and category != ALL_CATEGORIES:
        out = out.where(F.col("category") == F.lit(category))
    if search:
        out = out.where(search_filter(search))
    return out


def catalog_page(products: DataFrame, users: DataFrame, category: str | None = None,
                 search: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One catalogue page, most viewed first (B1, B2, F2).

    ``orderBy(...).offset(o).limit(n)`` plans as a top-(o+n) per partition
    and a small merge; the id tie-break makes pages stable.  For deep pages
    prefer :func:`catalog_page_after` (keyset paging).
    """
    page = with_artisan(filter_catalog(products, category, search), users)
    ordered = page.orderBy(F.col("views").desc(), F.col("id").asc())
    if offset:
        ordered = ordered.offset(offset)
    return _catalog_columns(ordered.limit(limit))


def catalog_page_after(products: DataFrame, users: DataFrame, after_views: int, after_id: int,
                       category: str | None = None, search: str | None = None,
                       limit: int = 20) -> DataFrame:
    """Keyset paging: the page that follows row ``(after_views, after_id)`` (F2)."""
    page = with_artisan(filter_catalog(products, category, search), users).where(
        (F.col("views") < after_views)
        | ((F.col("views") == after_views) & (F.col("id") > after_id))
    )
    return _catalog_columns(page.orderBy(F.col("views").desc(), F.col("id").asc()).limit(limit))


class PageDirectory:
    """Deep pages of one listing (B1, F2): the filtered catalogue written once in
    page order, so that any page is read from the one or two ranges that hold it.

    ``page(n)`` equals ``catalog_page(..., limit=size, offset=n * size)`` without
    sorting what comes before it.
    """

    def __init__(self, products: DataFrame, users: DataFrame, category: str | None = None,
                 search: str | None = None, size: int = 20):
        self.size = size
        self.order = [F.col("views").desc(), F.col("id").asc()]
        listing = _catalog_columns(with_artisan(filter_catalog(products, category, search), users))
        self.listing = RangeRanked(listing, self.order, "catalog-pages")

    @property
    def pages(self) -> int:
        return -(-self.listing.total // self.size)

    def page(self, number: int) -> DataFrame:
        return self.listing.between(number * self.size, self.size).orderBy(*self.order)

    def start_keys(self) -> DataFrame:
        """First row of every page, the key that keyset paging continues from."""
        return self.listing.ranked().where(F.col("rank") % self.size == 0).select(
            F.floor(F.col("rank") / self.size).alias("page"), "views", "id")


def own_products(products: DataFrame, principals: DataFrame) -> DataFrame:
    """Each artisan's own products, newest first (B9, batch form)."""
    return newest_first(owned_rows(products, "artisan_id", principals))


def all_products(products: DataFrame, users: DataFrame) -> DataFrame:
    """The admin's list of products with the artisan's name, newest first."""
    a = users.select(F.col("id").alias("artisan_id"), F.col("name").alias("artisan_name"))
    return newest_first(products.join(a, "artisan_id"))


def _catalog_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "name", "description", as_double(F.col("price")).alias("price"),
        as_double(F.col("bulk_price")).alias("bulk_price"), "min_bulk_qty", "category",
        "artisan_id", "stock", "views", "artisan_name", "artisan_location",
    )


def catalog_total(products: DataFrame) -> DataFrame:
    """Unfiltered product count, even when a page filter is on."""
    return products.agg(F.count(F.lit(1)).alias("total"))


def category_menu(products: DataFrame) -> DataFrame:
    """Distinct categories sorted, with 'All' first."""
    spark = products.sparkSession
    cats = products.select("category").distinct().select("category", F.lit(1).alias("sort_key"))
    head = spark.createDataFrame([(ALL_CATEGORIES, 0)], "category string, sort_key int")
    return head.unionByName(cats).orderBy("sort_key", "category").select("category", "sort_key")


def product_detail(products: DataFrame, users: DataFrame, ids: DataFrame) -> DataFrame:
    """Products for a set of ids with artisan name, location and phone."""
    wanted = products.join(ids.select(F.col("id")).distinct(), "id", "left_semi")
    return with_artisan(wanted, users, phone=True).select(
        "id", "name", "description", as_double(F.col("price")).alias("price"), "category",
        "stock", "views", "artisan_id", "artisan_name", "artisan_location", "artisan_phone",
    )


def order_detail(orders: DataFrame, items: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Lines of the given orders with product name, image and artisan name (C4).

    Batch form of the order page: order lines ⋈ products ⋈ artisan users,
    inner joins as in the reference (lines of a deleted product drop out).
    """
    ids = orders.select(F.col("id").alias("order_id"))
    p = products.select(F.col("id").alias("product_id"), "name", "image_url", "artisan_id")
    a = users.select(F.col("id").alias("artisan_id"), F.col("name").alias("artisan_name"))
    cols = ["order_id", "product_id", "quantity", "price"]
    return (
        items.select(*cols).join(ids, "order_id", "left_semi")
        .join(p, "product_id")
        .join(a, "artisan_id")
        .select("order_id", "product_id", "quantity", as_double(F.col("price")).alias("price"),
                "name", "image_url", "artisan_name")
    )


def related_products(products: DataFrame, k: int = 4, users: DataFrame | None = None) -> DataFrame:
    """Up to ``k`` other products of the same category, lowest ids first.

    With ``users``, products whose artisan is gone neither relate nor are
    related, and the related product's artisan is named.

    The k others of any product are always among the first k+1 of its
    category, so only those are kept per category (a partial top-(k+1)
    runs before the shuffle), then joined back on category: linear, exact.
    """
    if users is not None:
        a = users.select(F.col("id").alias("artisan_id"), F.col("name").alias("artisan_name"))
        products = products.select("id", "category", "artisan_id").join(a, "artisan_id")
    named = ["artisan_name"] if users is not None else []
    w_cat = Window.partitionBy("category").orderBy("id")
    firsts = (
        products.select("id", "category", *named)
        .withColumn("cat_rank", F.row_number().over(w_cat))
        .where(F.col("cat_rank") <= k + 1)
        .select(F.col("id").alias("related_id"), "category", "cat_rank", *named)
    )
    pairs = (
        products.select(F.col("id").alias("product_id"), "category")
        .join(firsts, "category")
        .where(F.col("product_id") != F.col("related_id"))
    )
    # Among the others of a product, one that follows it moves up by one.
    follows = (F.col("product_id") < F.col("related_id")).cast("int")
    return (
        pairs.withColumn("position", F.col("cat_rank") - follows)
        .where(F.col("position") <= k)
        .select("product_id", "related_id", "position", *named)
    )


def bulk_offers(products: DataFrame) -> DataFrame:
    """Wholesale offer per product, shown only when bulk price is set and non-zero."""
    has = F.coalesce(F.col("bulk_price"), F.lit(0)) != 0
    return products.select(
        "id", "name", as_double(F.col("price")).alias("price"),
        has.alias("has_bulk_offer"),
        as_double(F.when(has, F.col("bulk_price"))).alias("bulk_price"),
        F.when(has, F.col("min_bulk_qty")).alias("min_bulk_qty"),
    )


def bulk_quote(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Extension (claimed in prose only): unit price with the bulk rate applied
    when the line's quantity reaches the minimum bulk quantity."""
    p = products.select(F.col("id").alias("product_id"), "price", "bulk_price", "min_bulk_qty")
    has = F.coalesce(F.col("bulk_price"), F.lit(0)) != 0
    unit = F.when(has & (F.col("quantity") >= F.col("min_bulk_qty")), F.col("bulk_price")).otherwise(F.col("price"))
    return lines.join(p, "product_id").select(
        *[c for c in lines.columns],
        as_double(unit).alias("unit_price"),
        as_double(unit * F.col("quantity")).alias("line_amount"),
    )
