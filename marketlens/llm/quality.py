"""Quality scores: random Fourier features of document statistics.

Every text is reduced to ``STATISTICS`` (shares of byte classes, word, line
and repetition figures, compressibility).  Standardised statistics are mapped
to ``FEATURES`` random cosines, which approximate a Gaussian kernel.  Ridge
weights come from normal equations: each partition of labelled rows adds up
its own, Spark sums them entry by entry, and the driver solves a system of
``FEATURES`` unknowns.  Raw scores are calibrated by isotonic regression on
labelled rows that the weights have not seen, over ``BINS`` equal-count bins.

All labelled rows take part; only sums, bins and weights reach the driver,
and their sizes are fixed.  The statistics of all texts are written once and
serve for both fitting and scoring.

Defined results: null and empty texts have zero statistics and a score like
any other; without labelled rows every score is 0.5; one kind of label alone
gives a constant; repeated rows and ids give a row each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import materialize

from .registry import load, register
from .sample import fold

FEATURES = 256
RIDGE = 1.0
WIDTH = 8.0  # of the Gaussian kernel, in standard deviations
BINS = 100
SEED = 11

_CLASSES = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, (
        0 if _c in "abcdefghijklmnopqrstuvwxyz" else 1 if _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        else 2 if _c in "0123456789" else 3 if _c == "\n" else 4 if _c in " \t\r\f\v"
        else 5 if _c in ".,;:'\"-()" else 6 if _b < 128 else 7)] = 1
STATISTICS = (
    "lower", "upper", "digit", "line_end", "space", "stops", "symbols", "beyond_ascii",
    "exclamations", "log_bytes", "log_words", "word_length", "longest_word", "distinct_words",
    "commonest_word", "repeated_next_word", "hapax_words", "log_lines", "line_length",
    "repeated_lines", "short_lines", "compressed", "upper_words", "symbol_words",
)


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m, k = len(raw), max(1, len(words)), max(1, len(lines))
    often = Counter(words)
    rows = Counter(lines)
    return [
        *(counts @ _CLASSES / n), counts[33] / m, np.log1p(n), np.log1p(len(words)),
        sum(map(len, words)) / m, np.log1p(max(map(len, words), default=0)),
        len(often) / m, max(often.values(), default=0) / m,
        sum(map(str.__eq__, words[1:], words)) / m,
        sum(v == 1 for v in often.values()) / m,
        np.log1p(len(lines)), np.log1p(sum(map(len, lines)) / k),
        1 - len(rows) / k, sum(len(x) < 30 for x in lines) / k,
        len(zlib.compress(raw, 1)) / n,
        sum(v for w, v in often.items() if w.isupper() and len(w) > 1) / m,
        sum(v for w, v in often.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?)'\"") / m,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with an array column ``out`` of the text's statistics."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return docs.withColumn(out, run(F.col(text_col)))


class QualityModel:
    """Standardising figures, weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES - 1))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES - 1)
        self.weights = np.zeros(FEATURES)
        self.knots = np.zeros(0)
        self.levels = np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.cos(x @ self.turn + self.phase) * np.sqrt(2 / (FEATURES - 1))
        return np.column_stack([wave, np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), self.levels[0])
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of ``y`` along sorted ``x``: adjacent violators pool."""
    blocks: list[list[float]] = []  # value, weight, points
    for v, w in zip(y, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([[v] * n for v, _, n in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def fit_model(rows: DataFrame, calibrate: DataFrame) -> QualityModel:
    """Model from labelled rows (stats, y)."""
    k = len(STATISTICS)
    at = [F.col("stats")[i] for i in range(k)]
    moments = rows.agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    if not moments.n:
        return QualityModel(np.zeros(k), np.ones(k))
    model = QualityModel(
        np.array([moments[f"m{i}"] for i in range(k)]),
        np.array([moments[f"s{i}"] for i in range(k)]) + 1e-6)
    d = FEATURES

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            x, y = model.features(_matrix(batch.column(0))), np.asarray(batch.column(1))
            a += x.T @ x
            b += x.T @ y
        value = np.concatenate([a.ravel(), b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(value))), pa.array(value)], ["entry", "value"])

    total = (
        rows.select("stats", "y").mapInArrow(sums, "entry bigint, value double")
        .groupBy("entry").agg(F.sum("value").alias("value")).collect())
    entry = np.zeros(d * d + d)
    entry[[r.entry for r in total]] = [r.value for r in total]
    model.weights = np.linalg.solve(entry[:d * d].reshape(d, d) + RIDGE * np.eye(d), entry[d * d:])

    @F.arrow_udf("double")
    def raw(stats: pa.Array) -> pa.Array:
        return pa.array(model.raw(_matrix(stats)))

    held = calibrate.select(raw("stats").alias("raw"), "y")
    cuts = held.agg(F.percentile_approx(
        "raw", [i / BINS for i in range(1, BINS)], 100 * BINS).alias("q")).first().q
    if cuts is None:
        model.levels = np.array([label_mean(rows)])
        return model
    cuts = F.array(*[F.lit(float(q)) for q in sorted(set(cuts))])
    bins = (
        held.groupBy(F.size(F.filter(cuts, lambda q: q < F.col("raw"))).alias("bin"))
        .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n"))
        .orderBy("raw").collect())
    model.knots = np.array([r.raw for r in bins])
    model.levels = np.clip(isotonic(
        model.knots, np.array([r.y for r in bins]), np.array([float(r.n) for r in bins])), 0, 1)
    return model


def label_mean(rows: DataFrame) -> float:
    return float(rows.agg(F.avg("y").alias("y")).first().y)


def score_quality(measured: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """``measured`` (with column ``stats``) and its score in 0..1."""

    @F.arrow_udf("double")
    def run(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(stats)))

    return measured.withColumn(out, run("stats"))


@register("op6_quality")
def op6_quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    measured = materialize(with_statistics(docs).drop("text"), "quality-statistics")
    part = fold(F.col("doc_id"), 4)
    labels = (
        load(spark, sf_dir, "labels").filter(F.col("quality").isNotNull() & (part != 2))
        .select("doc_id", F.col("quality").cast("double").alias("y")))
    known = measured.join(labels, "doc_id").withColumn("fold", part)
    model = fit_model(known.filter("fold < 2"), known.filter("fold = 3"))
    return score_quality(measured, model).select(
        "doc_id", (part == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
