"""Structured Streaming over the page-view and cart-action logs.

* Capture (J1, J2) reuses the batch projections of
  :mod:`marketlens.operators.behavior` unchanged: they are stateless.
* Live page counts (J3) are tumbling-window aggregates with a watermark, so
  state for closed days is dropped; exact distinct visitors are not allowed
  in a stream, so the live figure is ``approx_count_distinct``.
* Live conversion (J4) is a global pair of conditional counts.
* View counters (J5) write each micro-batch's per-product deltas, and live
  visitors (J3) its sketches per day and page, to folded sinks
  (:mod:`marketlens.streaming.compaction`): a replay changes nothing, and a
  reader merges one snapshot and a short tail.
* Events delivered twice are dropped by id within the watermark, across
  restarts of the stream; the state of older ids expires.

Every sink is a folder on shared storage with a checkpoint folder beside it;
``foreachBatch`` writes are keyed by batch id so a restarted query that
replays a batch rewrites the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import behavior
from .compaction import EVERY, FoldedSink, latest, summed

SKETCH_BITS = 12  # 2**12 registers: a standard error of 1.04 / 64
DEFAULT_WATERMARK = "1 hour"
DEFAULT_WINDOW = "1 day"


def event_time(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Watermarks need TIMESTAMP; logs typed ``timestamp_ntz`` are cast (UTC session)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedupe_events(df: DataFrame, key: str = "id", column: str = "created_at",
                  delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """Drop re-delivered events (same id) within the watermark."""
    return event_time(df, column).withWatermark(column, delay).dropDuplicatesWithinWatermark([key])


def live_page_counts(views: DataFrame, window: str = DEFAULT_WINDOW,
                     delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """Views and approximate visitors per page per tumbling window."""
    v = event_time(views).withWatermark("created_at", delay)
    return (
        v.groupBy(F.window("created_at", window).alias("w"), "page")
        .agg(F.count(F.lit(1)).alias("views"),
             F.approx_count_distinct("session_id").alias("approx_visitors"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "page", "views", "approx_visitors")
    )


def live_conversion(cart: DataFrame) -> DataFrame:
    """Running add / checkout counts and the conversion rate (J4); complete mode."""
    return behavior.cart_conversion(cart)


def _start(stream: DataFrame, write, checkpoint: str, trigger: dict | None, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_upserts(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                  output_mode: str = "update", keys: list[str] | None = None,
                  every: int = EVERY) -> StreamingQuery:
    """Sink an updating aggregate: each micro-batch lands in ``batch_id=N``.

    Read the current result with :func:`read_upserts`.  A replayed batch
    overwrites its own folder, so the sink is idempotent.  With ``keys`` the
    folders are folded into a snapshot whenever there are ``every`` of them.
    """
    sink = FoldedSink(path, latest(keys), every) if keys else None

    def write(batch: DataFrame, batch_id: int) -> None:
        if sink is not None:
            sink.write(batch, batch_id)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(stream, write, checkpoint, trigger, output_mode)


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest row per key across the batches written by :func:`write_upserts`."""
    return FoldedSink(path, latest(keys)).read(spark)


def view_deltas(path: str, every: int = EVERY) -> FoldedSink:
    """Sink of views per product."""
    return FoldedSink(path, summed(["product_id"], ["views"]), every)


def write_view_deltas(views: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                      every: int = EVERY) -> StreamingQuery:
    """Per-product view counts of each micro-batch, folded into a snapshot."""
    sink = view_deltas(path, every)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(batch.groupBy("product_id").agg(F.count(F.lit(1)).alias("views")), batch_id)

    return _start(views, write, checkpoint, trigger)


def visitor_sketches(path: str, every: int = EVERY) -> FoldedSink:
    """Sink of views and visitor sketches per day and page."""
    return FoldedSink(path, summed(["day", "page"], ["views"], ["visitors"]), every)


def write_visitor_sketches(views: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                           every: int = EVERY) -> StreamingQuery:
    """Views and a HyperLogLog sketch of the sessions per day and page.

    Sketches merge, so there is no streaming state and no row is late: each
    micro-batch adds its own, and any span's visitors are the union of its
    days' (:func:`visitors_of`).  NULL sessions are views, not visitors."""
    sink = visitor_sketches(path, every)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(batch.groupBy(F.to_date("created_at").alias("day"), "page").agg(
            F.count(F.lit(1)).alias("views"),
            F.hll_sketch_agg("session_id", F.lit(SKETCH_BITS)).alias("visitors")), batch_id)

    return _start(views, write, checkpoint, trigger)


def visitors_of(sketches: DataFrame, *by: str) -> DataFrame:
    """Views and estimated visitors of the given days and pages, by any of
    ``day`` and ``page`` (of all together without)."""
    return sketches.groupBy(*by).agg(
        F.sum("views").alias("views"), F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors"))


def within_bound(estimate, exact):
    """Whether an estimate lies within three standard errors of a sketch."""
    return F.abs(estimate - exact) <= F.lit(3 * 1.04 / 2 ** (SKETCH_BITS / 2)) * exact + 1


def write_cart_actions(raw: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    """Cart-action capture with a rejected-rows side output (J2); a batch is
    read once for both."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        accepted, rejected = behavior.cart_action_rows(batch)
        accepted.write.mode("overwrite").parquet(f"{accepted_path}/batch_id={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        batch.unpersist()

    return _start(raw, write, checkpoint, trigger)


def write_append(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stateless stream to Parquet (J1 capture)."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
