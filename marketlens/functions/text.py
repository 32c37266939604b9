"""String and date helpers (H1–H9) as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the input sanitiser removes, the blanks that a
# JavaScript ``trim`` strips (white space plus line terminators), and the
# email shape test.
STRIPPED_CHARS = "<>\"'`"
JS_BLANKS = (
    "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029"
    "\\u202F\\u205F\\u3000\\uFEFF"
)
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PRODUCT_PATH = "/products/([0-9]+)"
API_PREFIX = "/api"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# Sanitiser length limits: auth (users), products, enquiries.
USER_TEXT_MAX = 255
PRODUCT_TEXT_MAX = 500
ENQUIRY_TEXT_MAX = 1000

_STRIP_CLASS = "[<>\"'`]"
# The browser's pattern in Java syntax: ``\s`` spelled as the JavaScript
# blank set, ``$`` as ``\z`` (Java's ``$`` also matches before a final newline).
_EMAIL_JAVA = EMAIL_SHAPE.replace(r"\s", JS_BLANKS)[:-1] + r"\z"
_TRIM = f"^[{JS_BLANKS}]+|[{JS_BLANKS}]+\\z"


def sanitize(c: Column, max_len: int = USER_TEXT_MAX) -> Column:
    """Drop ``< > " ' `````, trim JavaScript blanks, cut to ``max_len`` (H1).

    A non-string (NULL here) becomes ''.  Lengths count code points, the
    browser counts UTF-16 units; they differ only outside the BMP (T3).
    """
    cleaned = F.regexp_replace(F.regexp_replace(c, _STRIP_CLASS, ""), _TRIM, "")
    return F.coalesce(F.substring(cleaned, 1, max_len), F.lit(""))


def email_ok(c: Column) -> Column:
    """Email shape test with JavaScript's end anchor and blanks.

    Java's ``$`` also matches before a final newline; ``\\z`` does not.
    NULL input fails the test.
    """
    return F.coalesce(c.rlike(_EMAIL_JAVA), F.lit(False))


def product_id_from_path(path: Column, pattern: str = PRODUCT_PATH) -> Column:
    """First captured digit run of an unanchored path pattern, else NULL (H3)."""
    digits = F.regexp_extract(path, pattern, 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def is_page_request(method: Column, path: Column, api_prefix: str = API_PREFIX) -> Column:
    """GET, not under the API prefix, no '.' in the path."""
    return (
        (method == F.lit("GET"))
        & ~path.startswith(api_prefix)
        & ~path.contains(".")
    )


URL_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_path(url: Column) -> Column:
    """Path part of an absolute URL (no query, no fragment), like ``req.path``.

    A regular expression rather than ``parse_url``, which fails on a
    malformed URL under ANSI mode; no match gives ''.
    """
    return F.regexp_extract(url, URL_PATH, 1)


def first_at_token(c: Column) -> Column:
    """First blank-delimited token that contains '@' (or '').

    The cheap ``contains`` test runs first so the regular expression only
    scans texts that can match.
    """
    return F.when(c.contains("@"), F.regexp_extract(c, r"\S*@\S*", 0)).otherwise(F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Fold ASCII letters only, as SQLite's ``LIKE`` does."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def like_contains(c: Column, needle: str, escape: str = "!") -> Column:
    """``c LIKE '%needle%'`` with SQLite semantics.

    User ``%`` and ``_`` stay wildcards; the escape character is doubled in
    the needle so it always means itself, and a backslash is a plain
    character.  Case folding is ASCII-only.
    """
    body = needle.replace(escape, escape + escape).translate(
        str.maketrans(ASCII_UPPER, ASCII_LOWER)
    )
    return F.like(ascii_lower(c), F.lit(f"%{body}%"), F.lit(escape))


def first_ten(c: Column) -> Column:
    """First ten characters of a timestamp string: the date key (H8)."""
    return F.substring(c.cast("string"), 1, 10)


def city(address: Column) -> Column:
    """First comma-separated part of an address (H9)."""
    return F.split_part(address, F.lit(","), F.lit(1))
