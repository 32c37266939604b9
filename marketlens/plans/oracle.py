"""DuckDB statements that compute what each registered query computes.

The shop frames of :mod:`marketlens.sources.adapter` are restated here as
CTEs over the driver's views, so each statement is self-contained ANSI SQL.
Rules shared by all statements: money is DECIMAL(18,2) before any SUM and
DOUBLE on output; integer sums are cast to BIGINT; every top-k has a unique
tie-break.
"""

from __future__ import annotations

# CTE name -> (dependencies, body).  Names carry an ``s_`` prefix so they do
# not shadow the driver's own views.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "s_customers": ((), """
        SELECT c.c_custkey AS id, c.c_name AS name, c.c_name AS email,
               'customer' AS role, CAST(NULL AS VARCHAR) AS phone, n.n_name AS address
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    "s_artisans": ((), """
        SELECT 1000000000000 + s.s_suppkey AS id, s.s_name AS name, s.s_name AS email,
               'artisan' AS role, CAST(NULL AS VARCHAR) AS phone, n.n_name AS address
        FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"""),
    "s_product_views": ((), """
        SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
               COUNT(*) AS views
        FROM events WHERE event_type = 'view' GROUP BY 1"""),
    "s_products": (("s_product_views",), """
        SELECT p.p_partkey AS id, p.p_name AS name, p.p_brand AS description,
               CAST(p.p_retailprice AS DECIMAL(18,2)) AS price,
               CASE WHEN p.p_type = 'ECONOMY' THEN CAST(NULL AS DECIMAL(18,2))
                    WHEN p.p_type = 'SMALL' THEN CAST(0 AS DECIMAL(18,2))
                    ELSE CAST(ROUND(CAST(p.p_retailprice AS DECIMAL(18,2))
                                    * CAST(0.85 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))
               END AS bulk_price,
               10 AS min_bulk_qty, p.p_type AS category,
               CAST(NULL AS VARCHAR) AS image_url, p.p_size AS stock,
               COALESCE(v.views, 0) AS views
        FROM part p LEFT JOIN s_product_views v ON v.product_id = p.p_partkey"""),
    "s_product_owner": ((), """
        SELECT l_partkey AS product_id, 1000000000000 + MIN(l_suppkey) AS artisan_id,
               MIN(l_shipdate) AS created_at
        FROM lineitem GROUP BY 1"""),
    "s_admins": ((), """
        SELECT 2000000000000 + n_nationkey AS id, n_name AS name, n_name AS email, 'admin' AS role,
               CAST(NULL AS VARCHAR) AS phone, n_name AS address
        FROM nation"""),
    "s_products_owned": (("s_products", "s_product_owner"), """
        SELECT p.*, o.artisan_id, o.created_at FROM s_products p JOIN s_product_owner o ON o.product_id = p.id"""),
    "s_orders": ((), """
        SELECT o_orderkey AS id, o_custkey AS customer_id,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
               CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'O' THEN 'confirmed'
                                  WHEN 'F' THEN 'delivered' END AS status,
               o_orderdate AS created_at
        FROM orders"""),
    "s_items": ((), """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS supplier_id,
               l_linenumber AS line_number, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(CAST(CAST(FLOOR(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT)
                         AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS price,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total
        FROM lineitem"""),
    "s_page_views": ((), """
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, user_id,
               '/products/' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS page,
               TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
               ts AS created_at
        FROM events WHERE event_type = 'view'"""),
    "s_cart_actions": ((), """
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, user_id,
               TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
               CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'checkout' END AS action,
               1 AS quantity, ts AS created_at
        FROM events WHERE event_type IN ('click', 'purchase')"""),
    "s_lines": (("s_orders", "s_customers", "s_items", "s_products"), """
        SELECT o.id AS order_id, u.name AS customer, u.email, o.total_amount, o.status,
               o.created_at, p.name AS product, p.category, i.quantity, i.price, i.line_total
        FROM s_orders o
        JOIN s_customers u ON o.customer_id = u.id
        JOIN s_items i ON i.order_id = o.id
        JOIN s_products p ON i.product_id = p.id"""),
}


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs and everything they depend on."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in CTES[n][0]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in ordered)
    return f"WITH {parts}\n{body.strip()}"


# --- SQL spellings of the text helpers (DuckDB / RE2 syntax) -------------------
JS_BLANKS_RE2 = (r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                 r"\x{202F}\x{205F}\x{3000}\x{FEFF}")


def sql_sanitize(expr: str, n: int) -> str:
    """DuckDB form of :func:`marketlens.functions.text.sanitize`."""
    b = JS_BLANKS_RE2
    stripped = f"regexp_replace({expr}, '[<>\"''`]', '', 'g')"
    trimmed = f"regexp_replace({stripped}, '^[{b}]+|[{b}]+$', '', 'g')"
    return f"COALESCE(substring({trimmed}, 1, {n}), '')"


def sql_email_ok(expr: str) -> str:
    """DuckDB form of :func:`marketlens.functions.text.email_ok`."""
    b = JS_BLANKS_RE2
    return f"COALESCE(regexp_full_match({expr}, '[^{b}@]+@[^{b}@]+\\.[^{b}@]+'), FALSE)"


def sql_falsy(expr: str) -> str:
    """JavaScript falsiness of a text value: NULL or ''."""
    return f"({expr} IS NULL OR {expr} = '')"


def sql_parse_int(expr: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({expr}, '^[\\s]*([+-]?[0-9]+)', 1), '') AS BIGINT)"


CTES["s_raw_enquiries"] = ((), r"""
        SELECT doc_id AS id, source AS company_name, lang AS contact_person,
               regexp_extract(text, '\S*@\S*', 0) AS email, CAST(NULL AS VARCHAR) AS phone,
               lang AS product_category, CAST(n_chars AS VARCHAR) AS quantity, text AS message
        FROM documents""")
CTES["s_enquiry_checked"] = (("s_raw_enquiries",), f"""
        SELECT *, CASE WHEN {sql_falsy('company_name')} OR {sql_falsy('contact_person')} OR {sql_falsy('email')}
                       THEN 'missing_fields'
                       WHEN NOT {sql_email_ok('email')} THEN 'bad_email' END AS reason
        FROM s_raw_enquiries""")
CTES["s_enquiries"] = (("s_enquiry_checked",), f"""
        SELECT id, {sql_sanitize('company_name', 1000)} AS company_name,
               {sql_sanitize('contact_person', 1000)} AS contact_person,
               {sql_sanitize('email', 1000)} AS email,
               {sql_sanitize("COALESCE(phone, '')", 1000)} AS phone,
               {sql_sanitize("COALESCE(product_category, '')", 1000)} AS product_category,
               CASE WHEN NOT {sql_falsy('quantity')} THEN {sql_parse_int('quantity')} END AS quantity,
               {sql_sanitize("COALESCE(message, '')", 1000)} AS message,
               'pending' AS status, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id) AS created_at
        FROM s_enquiry_checked WHERE reason IS NULL""")
