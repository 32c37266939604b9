"""Window building blocks that stay balanced when one key is very hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_WIDTH = 1 << 20


def seq_bounds(df: DataFrame, order: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` cut points that split ``order`` into ranges of
    about equal counts, however its values are spaced."""
    cuts = [k / buckets for k in range(1, buckets)]
    got = df.agg(F.percentile_approx(order, cuts, 20 * buckets).alias("q")).first().q
    return sorted(set(got or []))


def sum_before(df: DataFrame, key: str, order: str, values: dict[str, "F.Column"],
               bucket_width: int | None = None, bounds: list[int] | None = None) -> DataFrame:
    """Add ``out = Σ value`` over earlier rows of the same key (strictly smaller ``order``).

    A plain running window puts every row of a key into one task.  Here the
    order axis is cut into buckets at ``bounds`` (see ``seq_bounds``) or of
    ``bucket_width``: the running sum runs inside each (key, bucket), bucket
    totals are summed per key (one row per bucket), and the two are added.  ``order`` must be an integral column,
    unique within a key.
    Without cut points there is one bucket, whose running sum is the result.
    """
    if bounds is not None and not bounds:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(n) for n, v in values.items()])
    if bounds is not None:
        cuts = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
        bucket = F.size(F.filter(cuts, lambda b: b <= F.col(order))).cast("bigint")
    else:
        bucket = F.floor(F.col(order) / F.lit(bucket_width or DEFAULT_BUCKET_WIDTH)).cast("bigint")
    staged = df.withColumn("_bucket", bucket)
    w_in = (Window.partitionBy(key, "_bucket").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1))
    for name, value in values.items():
        staged = staged.withColumn(f"_{name}_v", value).withColumn(
            f"_{name}_in", F.coalesce(F.sum(f"_{name}_v").over(w_in), F.lit(0))
        )
    totals = staged.groupBy(key, "_bucket").agg(
        *[F.sum(f"_{name}_v").alias(f"_{name}_t") for name in values]
    )
    w_b = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        key, "_bucket",
        *[F.coalesce(F.sum(f"_{name}_t").over(w_b), F.lit(0)).alias(f"_{name}_off") for name in values],
    )
    out = staged.join(offsets, [key, "_bucket"])
    for name in values:
        out = out.withColumn(name, F.col(f"_{name}_in") + F.col(f"_{name}_off"))
    drop = ["_bucket"] + [f"_{n}_{s}" for n in values for s in ("v", "in", "off")]
    return out.drop(*drop)


PLACE_BITS = 33  # monotonically_increasing_id: partition above, row below


class RangeRanked:
    """Rows written once in the total order of ``order``, one file a range.

    Rows are dealt to ranges of the order (one shuffle), sorted there and
    written with their place, ``_place`` = range and row within it.  Only the
    rows of each range are counted on the driver (one number a shuffle
    partition), which turns a place into a rank over all rows and a rank into
    the range that holds it.  ``order`` must name a total order, so equal keys
    that fill a range are no concern: the last key is unique.
    """

    def __init__(self, df: DataFrame, order: list, name: str):
        from ..session import materialize

        self.rows = materialize(
            df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_place", F.monotonically_increasing_id()), name)
        self.columns = df.columns
        counts = self.rows.groupBy(F.shiftright("_place", PLACE_BITS).alias("r")).count().collect()
        self.ranges, self.total = [], 0
        for r, n in sorted((c["r"], c["count"]) for c in counts):
            self.ranges.append((r, self.total, n))
            self.total += n

    def ranked(self, out: str = "rank") -> DataFrame:
        """All rows with their rank from 0; one row a range is broadcast."""
        starts = self.rows.sparkSession.createDataFrame(
            [(r, first) for r, first, _ in self.ranges], "_range bigint, _first bigint")
        place = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        return (
            self.rows.withColumn("_range", F.shiftright("_place", PLACE_BITS))
            .join(F.broadcast(starts), "_range")
            .select(*self.columns, (F.col("_first") + place).alias(out))
        )

    def between(self, first: int, count: int) -> DataFrame:
        """The rows of ranks ``first`` up to ``first + count``, unsorted; files of
        other ranges are skipped by the least and greatest place they hold."""
        wanted = F.lit(False)
        for r, start, n in self.ranges:
            low, high = max(first - start, 0), min(first + count - start, n) - 1
            if low <= high:
                wanted = wanted | F.col("_place").between((r << PLACE_BITS) + low, (r << PLACE_BITS) + high)
        return self.rows.where(wanted).select(*self.columns)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` per key, as a partial aggregate.

    ``max_by`` over a struct combines map-side, so a key with millions of
    rows costs one row per map task in the shuffle.
    """
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.max_by(F.struct(*others), F.col(order)).alias("_last")
    )
    return picked.select(key, *[F.col(f"_last.{c}").alias(c) for c in others])


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` per key, as a partial aggregate."""
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.min_by(F.struct(*others), F.col(order)).alias("_first")
    )
    return picked.select(key, *[F.col(f"_first.{c}").alias(c) for c in others])
