"""Streaming forms agree with the batch forms on the same input."""

import datetime as dt
import os

from pyspark.sql import functions as F

from marketlens import schema as S
from marketlens.operators import behavior
from marketlens.streaming import live


def _write_batches(spark, df, path, parts):
    for i, chunk in enumerate(df.randomSplit([1.0] * parts, seed=3)):
        chunk.write.mode("append").parquet(os.path.join(path, f"part{i}"))


def _views(spark):
    t0 = dt.datetime(2024, 1, 15, 10)
    rows = [(i, f"s{i % 7}", i % 3 or None, f"/products/{i % 4}", i % 4, t0 + dt.timedelta(hours=i))
            for i in range(120)]
    return spark.createDataFrame(rows, S.PAGE_VIEWS)


def test_live_page_counts_equal_batch(spark, scratch_dir):
    src = os.path.join(scratch_dir, "views")
    _views(spark).write.parquet(src)
    stream = spark.readStream.schema(S.PAGE_VIEWS).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = os.path.join(scratch_dir, "out"), os.path.join(scratch_dir, "ck")
    # Files may be picked up in any order; the delay admits every row as on time.
    q = live.write_upserts(live.live_page_counts(stream, delay="30 days"), out, ck)
    q.awaitTermination()
    got = {(r.window_start.date().isoformat(), r.page): r.views
           for r in live.read_upserts(spark, out, ["window_start", "page"]).collect()}
    want = {(r.d, r.page): r.n for r in _views(spark).groupBy(F.to_date("created_at").cast("string").alias("d"), "page")
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_rows_behind_the_watermark_are_dropped(spark, scratch_dir):
    t0 = dt.datetime(2024, 1, 15, 10)
    first = [(1, "s", None, "/a", None, t0 + dt.timedelta(hours=48))]
    late = [(2, "s", None, "/a", None, t0)]
    src = os.path.join(scratch_dir, "views")
    spark.createDataFrame(first, S.PAGE_VIEWS).write.parquet(os.path.join(src, "b1"))
    out, ck = os.path.join(scratch_dir, "out"), os.path.join(scratch_dir, "ck")
    reader = lambda: spark.readStream.schema(S.PAGE_VIEWS).parquet(os.path.join(src, "*"))
    live.write_upserts(live.live_page_counts(reader()), out, ck).awaitTermination()
    spark.createDataFrame(late, S.PAGE_VIEWS).write.parquet(os.path.join(src, "b2"))
    live.write_upserts(live.live_page_counts(reader()), out, ck).awaitTermination()
    days = {r.window_start.date().isoformat() for r in live.read_upserts(spark, out, ["window_start", "page"]).collect()}
    assert days == {"2024-01-17"}


def test_view_deltas_are_idempotent_per_batch(spark, scratch_dir):
    src = os.path.join(scratch_dir, "views")
    _views(spark).write.parquet(src)
    stream = spark.readStream.schema(S.PAGE_VIEWS).parquet(src)
    out, ck = os.path.join(scratch_dir, "deltas"), os.path.join(scratch_dir, "ck")
    live.write_view_deltas(stream, out, ck).awaitTermination()
    # A restart on the same checkpoint finds nothing new and writes nothing.
    live.write_view_deltas(spark.readStream.schema(S.PAGE_VIEWS).parquet(src), out, ck).awaitTermination()
    total = spark.read.parquet(out).groupBy("product_id").agg(F.sum("views").alias("n"))
    assert {r.product_id: r.n for r in total.collect()} == {0: 30, 1: 30, 2: 30, 3: 30}


def test_conversion_stream_complete_mode(spark, scratch_dir):
    rows = [(i, "s", 1, 1, "add" if i % 3 else "checkout", 1, dt.datetime(2024, 1, 1)) for i in range(30)]
    src = os.path.join(scratch_dir, "cart")
    spark.createDataFrame(rows, S.CART_ACTIONS).write.parquet(src)
    stream = spark.readStream.schema(S.CART_ACTIONS).parquet(src)
    out, ck = os.path.join(scratch_dir, "conv"), os.path.join(scratch_dir, "ck")
    live.write_upserts(live.live_conversion(stream), out, ck, output_mode="complete").awaitTermination()
    df = spark.read.parquet(out)
    r = df.where(F.col("batch_id") == df.agg(F.max("batch_id")).first()[0]).first()
    assert (r.cart_additions, r.checkouts, r.conversion_rate) == (20, 10, 50.0)


def test_capture_streams(spark, scratch_dir):
    reqs = spark.createDataFrame([
        (None, "GET", "/products/12", "s1", None), (None, "GET", "/api/products", "s1", 5),
        (None, "GET", "/style.css", "s2", None), (None, "POST", "/products/3", "s2", 5),
        (None, "GET", "/", "s3", 6)], S.REQUEST_LOG)
    src = os.path.join(scratch_dir, "reqs")
    reqs.write.parquet(src)
    out, ck = os.path.join(scratch_dir, "pv"), os.path.join(scratch_dir, "ck1")
    rows = behavior.page_view_rows(spark.readStream.schema(S.REQUEST_LOG).parquet(src))
    live.write_append(rows, out, ck).awaitTermination()
    got = sorted((r.page, r.product_id, r.user_id) for r in spark.read.parquet(out).collect())
    assert got == [("/", None, 6), ("/products/12", 12, None)]

    raw = spark.createDataFrame([("7", "add", None, "s", 1, None), ("", "add", 2, "s", 1, None),
                                 ("8", "wish", 1, "s", 1, None), ("x9", "checkout", 0, "s", 1, None)],
                                "productId string, action string, quantity int, session_id string, user_id long, ts timestamp")
    src2 = os.path.join(scratch_dir, "track")
    raw.write.parquet(src2)
    acc, rej = os.path.join(scratch_dir, "acc"), os.path.join(scratch_dir, "rej")
    live.write_cart_actions(spark.readStream.schema(raw.schema).parquet(src2), acc, rej,
                            os.path.join(scratch_dir, "ck2")).awaitTermination()
    assert sorted((r.product_id, r.action, r.quantity) for r in spark.read.parquet(acc).collect()) == [(7, "add", 1)]
    assert sorted(r.reason for r in spark.read.parquet(rej).collect()) == [
        "action_not_allowed", "bad_product_id", "missing_fields"]


def test_dedupe_within_watermark(spark, scratch_dir):
    rows = [(1, "s", None, "/", None, dt.datetime(2024, 1, 1, 10)), (1, "s", None, "/", None, dt.datetime(2024, 1, 1, 10)),
            (2, "s", None, "/", None, dt.datetime(2024, 1, 1, 11))]
    src = os.path.join(scratch_dir, "dup")
    spark.createDataFrame(rows, S.PAGE_VIEWS).write.parquet(src)
    stream = live.dedupe_events(spark.readStream.schema(S.PAGE_VIEWS).parquet(src))
    out, ck = os.path.join(scratch_dir, "dd"), os.path.join(scratch_dir, "ck")
    live.write_append(stream, out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_live_visitors_close_to_exact(spark, scratch_dir):
    t0 = dt.datetime(2024, 1, 15, 10)
    rows = [(i, f"s{i % 400}", None, "/p", None, t0 + dt.timedelta(seconds=i)) for i in range(4000)]
    src = os.path.join(scratch_dir, "views")
    spark.createDataFrame(rows, S.PAGE_VIEWS).write.parquet(src)
    out, ck = os.path.join(scratch_dir, "out"), os.path.join(scratch_dir, "ck")
    live.write_upserts(live.live_page_counts(spark.readStream.schema(S.PAGE_VIEWS).parquet(src)), out, ck
                       ).awaitTermination()
    r = live.read_upserts(spark, out, ["window_start", "page"]).first()
    assert r.views == 4000
    assert abs(r.approx_visitors - 400) <= 0.05 * 400   # default relative error of the sketch


def _sink_rows(sink, spark):
    return {r.product_id: r.views for r in sink.read(spark).collect()}


def test_fifty_batches_leave_one_snapshot_and_an_open_tail(spark, scratch_dir):
    from marketlens.session import list_folder

    views, src = _views(spark), os.path.join(scratch_dir, "views")
    views.repartition(50, "id").write.option("maxRecordsPerFile", 2).parquet(src)
    files = len([n for n in list_folder(spark, src) if n.startswith("part-")])
    assert files >= 50
    out, ck = os.path.join(scratch_dir, "out"), os.path.join(scratch_dir, "ck")
    stream = spark.readStream.schema(S.PAGE_VIEWS).option("maxFilesPerTrigger", 1).parquet(src)
    live.write_view_deltas(stream, out, ck, every=10).awaitTermination()
    sink = live.view_deltas(out, every=10)
    assert _sink_rows(sink, spark) == {0: 30, 1: 30, 2: 30, 3: 30}
    assert len(list_folder(spark, f"{out}/_folded")) == 1
    assert len(sink.tail(spark)) < 10 and sink.folded_through(spark) >= 39
    # Replays of folded and of open batches change nothing.
    wrong = spark.createDataFrame([(0, 1000)], "product_id long, views long")
    sink.write(wrong, 3)
    last = sink.tail(spark)[-1]
    same = spark.read.parquet(f"{out}/batch_id={last}")
    kept = same.collect()
    sink.write(spark.createDataFrame(kept, same.schema), last)
    assert _sink_rows(sink, spark) == {0: 30, 1: 30, 2: 30, 3: 30}


def test_an_unfinished_fold_is_not_seen(spark, scratch_dir):
    out = os.path.join(scratch_dir, "out")
    sink = live.view_deltas(out, every=100)
    for i in range(4):
        sink.write(spark.createDataFrame([(1, 1), (i, 5)], "product_id long, views long"), i)
    want = _sink_rows(sink, spark)
    # A fold that stopped before its marker: rows but no _SUCCESS.
    spark.createDataFrame([(9, 9)], "product_id long, views long").write.parquet(f"{out}/_folded/through=3")
    os.remove(f"{out}/_folded/through=3/_SUCCESS")
    assert sink.folded_through(spark) == -1 and _sink_rows(sink, spark) == want
    sink.fold(spark)
    assert sink.folded_through(spark) == 3 and sink.tail(spark) == [] and _sink_rows(sink, spark) == want


def test_upserts_keep_the_last_row_of_a_key_over_folds(spark, scratch_dir):
    from marketlens.streaming.compaction import FoldedSink, latest

    sink = FoldedSink(os.path.join(scratch_dir, "out"), latest(["k"]), every=3)
    for i in range(8):
        rows = [(i % 3, i), (None, i), (100 + i, 0)]
        sink.write(spark.createDataFrame(rows, "k long, v long"), i)
    got = {r.k: r.v for r in sink.read(spark).collect()}
    assert got == {0: 6, 1: 7, 2: 5, None: 7} | {100 + i: 0 for i in range(8)}


def test_sketches_of_days_merge_to_any_span(spark, scratch_dir):
    t0 = dt.datetime(2024, 1, 15, 10)
    rows = [(i, f"s{i % 900}" if i % 10 else None, None, f"/p{i % 2}", None, t0 + dt.timedelta(minutes=i))
            for i in range(6000)]
    src = os.path.join(scratch_dir, "views")
    spark.createDataFrame(rows, S.PAGE_VIEWS).repartition(9).write.parquet(src)
    stream = spark.readStream.schema(S.PAGE_VIEWS).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = os.path.join(scratch_dir, "out"), os.path.join(scratch_dir, "ck")
    live.write_visitor_sketches(stream, out, ck, every=4).awaitTermination()
    sketches = live.visitor_sketches(out).read(spark)
    views = spark.createDataFrame(rows, S.PAGE_VIEWS)
    for by in ((), ("page",), ("day",), ("day", "page")):
        got = {tuple(r[c] for c in by): (r.views, r.visitors) for r in live.visitors_of(sketches, *by).collect()}
        want = views.withColumn("day", F.to_date("created_at")).groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("v")).collect()
        assert len(got) == len(want)
        for r in want:
            n, v = got[tuple(r[c] for c in by)]
            assert n == r.n and abs(v - r.v) <= 3 * 1.04 / 64 * r.v + 1
