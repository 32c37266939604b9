"""Skew-safe window helpers against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators.windows import first_per_key, last_per_key, sum_before


def test_sum_before_matches_plain_window(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b"]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in sum_before(df, "k", "o", {"s": F.col("v")}, bucket_width=16).collect()}
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r.k, r.o): r.s for r in df.select("k", "o", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).collect()}
    assert got == want


def test_last_and_first_per_key(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (2, "c", 1), (1, "d", 4)], "id long, v string, seq long")
    assert {r.id: r.v for r in last_per_key(df, "id", "seq").collect()} == {1: "b", 2: "c"}
    assert {r.id: r.v for r in first_per_key(df, "id", "seq").collect()} == {1: "a", 2: "c"}


def test_ranges_rank_all_rows_and_read_only_what_a_page_needs(spark):
    from marketlens.operators.windows import RangeRanked

    # One value for most rows: the id still splits it.
    df = spark.range(500).select("id", F.when(F.col("id") < 400, F.lit(1)).otherwise(F.col("id") % 7).alias("v"))
    want = sorted(((r.v, r.id) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    ranked = RangeRanked(df, [F.col("v").desc(), F.col("id")], "ranked-test")
    assert ranked.total == 500
    assert [(r.v, r.id) for r in ranked.ranked().orderBy("rank").collect()] == want
    assert sorted(r["rank"] for r in ranked.ranked().collect()) == list(range(500))
    for first, count in [(0, 20), (240, 20), (490, 20), (500, 20)]:
        got = [(r.v, r.id) for r in ranked.between(first, count).collect()]
        assert sorted(got, key=lambda x: (-x[0], x[1])) == want[first:first + count]
    empty = RangeRanked(df.limit(0), [F.col("id")], "ranked-empty")
    assert empty.total == 0 and empty.ranked().count() == 0 and empty.between(0, 5).count() == 0
