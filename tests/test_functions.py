"""Column helpers against the traps listed in the survey."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions import numeric, text


def _one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw,expected", [
    ('  <b>Hi</b> "x" ', "bHi/b x"),
    ("\t\n tab and newline \r\n", "tab and newline"),
    (" nbsp　", "nbsp"),
    ("it's `code`", "its code"),
    (None, ""),
])
def test_sanitize(spark, raw, expected):
    assert _one(spark, lambda c: text.sanitize(c, 255), raw) == expected


def test_sanitize_cuts_length(spark):
    assert _one(spark, lambda c: text.sanitize(c, 5), "  abcdefgh") == "abcde"


@pytest.mark.parametrize("raw,ok", [
    ("a@b.c", True), ("a@b.c\n", False), ("a b@c.d", False), ("a@b", False),
    ("x.y@mail.example.com###", True), ("@b.c", False), (None, False), ("a@b.c ", False),
])
def test_email_shape(spark, raw, ok):
    assert _one(spark, text.email_ok, raw) is ok


def test_like_contains_wildcards_and_escape(spark):
    df = spark.createDataFrame(
        [(1, "100% Cotton"), (2, "a_b"), (3, "axb"), (4, "back\\slash"), (5, "wow!"), (6, "ÉCLAIR")], "id int, s string")

    def ids(q):
        return sorted(r.id for r in df.where(text.like_contains(F.col("s"), q)).collect())

    assert ids("COTTON") == [1]
    assert ids("a_b") == [2, 3]          # user '_' stays a wildcard
    assert ids("0%c") == [1]             # user '%' stays a wildcard
    assert ids("k\\s") == [4]            # backslash is a plain character
    assert ids("w!") == [5]              # the escape character means itself
    assert ids("éclair") == []           # ASCII-only case folding, as SQLite


def test_product_id_from_path(spark):
    f = lambda c: text.product_id_from_path(c)
    assert _one(spark, f, "/products/42") == 42
    assert _one(spark, f, "/shop/products/7/reviews") == 7
    assert _one(spark, f, "/products/") is None
    assert _one(spark, f, "/products/99999999999999999999") is None


def test_is_page_request(spark):
    df = spark.createDataFrame([("GET", "/products/1"), ("GET", "/api/x"), ("GET", "/app.js"),
                                ("POST", "/products/1")], "m string, p string")
    got = [r.p for r in df.where(text.is_page_request(F.col("m"), F.col("p"))).collect()]
    assert got == ["/products/1"]


def test_parse_int_and_float(spark):
    assert _one(spark, numeric.parse_int_js, " 42abc") == 42
    assert _one(spark, numeric.parse_int_js, "-7") == -7
    assert _one(spark, numeric.parse_int_js, "abc") is None
    assert _one(spark, numeric.parse_float_js, "3.5e2x") == 350.0
    assert _one(spark, numeric.parse_float_js, ".5") == 0.5
    assert _one(spark, numeric.parse_float_js, "") is None


def test_lenient_numbers_from_csv(spark):
    assert _one(spark, numeric.lenient_int, "") == 0
    assert _one(spark, numeric.lenient_int, None) == 0
    assert _one(spark, numeric.lenient_int, " 3 ") == 3
    assert float(_one(spark, numeric.money_or_zero, "")) == 0.0
    assert float(_one(spark, numeric.money_or_zero, "849.99")) == 849.99


def test_js_or(spark):
    assert _one(spark, lambda c: numeric.js_or(c, 1), 0, "int") == 1
    assert _one(spark, lambda c: numeric.js_or(c, 1), None, "int") == 1
    assert _one(spark, lambda c: numeric.js_or(c, 1), 4, "int") == 4
    assert _one(spark, lambda c: numeric.js_or(c, "d", text=True), "") == "d"


def test_percent_half_up_and_zero_division(spark):
    df = spark.createDataFrame([(29, 20), (1, 0), (1, 3)], "a long, b long")
    got = [r.p for r in df.select(numeric.percent(F.col("a"), F.col("b"), 1).alias("p")).collect()]
    assert got == [145.0, 0.0, 33.3]


def test_clamp_to_stock_keeps_null(spark):
    df = spark.createDataFrame([(None, 5), (7, 5), (2, None)], "q int, s int")
    got = [r.c for r in df.select(numeric.clamp_to_stock(F.col("q"), F.col("s")).alias("c")).collect()]
    assert got == [None, 5, None]


def test_city_and_first_ten(spark):
    assert _one(spark, text.city, "North Side, Town") == "North Side"
    assert _one(spark, text.first_ten, "2024-01-15 10:00:00") == "2024-01-15"
