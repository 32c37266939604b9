"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one
on toxic text.  A window of ``WINDOW_WORDS`` words is compressed with the
ordinary dictionary alone and with the toxic one appended; the bytes saved are
its distance.  A document's features are the shares of its windows that save
at least 1, 2, 3 and 4 bytes, the largest saving and the number of windows;
a logistic curve over them, fitted on labelled rows, is the score, and its
threshold is calibrated so that 0.5 gives the best F1 score on those rows.

Toxic documents are mostly ordinary words, so the toxic dictionary is trained
on the spans that tell them apart: runs covered by byte 8-grams that occur in
at least ``MIN_DOCS`` sampled toxic documents and ``MIN_RATIO`` times as often
there as in ordinary ones.

Training uses bounded samples of labelled rows (``TRAIN_TOXIC`` and
``TRAIN_ORDINARY`` documents), and whole texts of those: the curve is fitted on
distances that tasks measure on whole texts, to dictionaries trained without
the row's half.  Dictionaries are trained on whole texts too; only if a kind's
sampled texts exceed ``TRAIN_BYTES`` together, each gives the same share of its
windows, spread evenly over all of it.  The ordinary dictionary takes at most
``ORDINARY_WINDOWS`` of a text, likewise spread, so that a few long texts do
not fill it.  Every text is scored whole.

Defined results: null and empty texts have no window and score as a document
that saves nothing; without labels of both kinds every score is 0; repeated
rows and ids give a row each; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import materialize, release

from .registry import load, register
from .sample import bounded_sample, fold

WINDOW_WORDS = 8
LEVEL = 12
ORDINARY_BYTES = 12_000
TOXIC_BYTES = 2_048
SEGMENT = 16  # bytes of a segment that the toxic dictionary may take
TRAIN_TOXIC = 2_000
TRAIN_ORDINARY = 4_000
TRAIN_BYTES = 16 << 20
ORDINARY_WINDOWS = 120  # of a text, for the ordinary dictionary
GRAMS = (8,)  # bytes
MIN_DOCS = 3
MIN_SHARE = 0.006
MIN_RATIO = 8

_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and non-ASCII characters."""
    return _WORD.findall((text or "").encode().translate(_LOWER))


def windows(text: str | None) -> list[bytes]:
    w = words(text)
    return [b" %b " % b" ".join(w[i:i + WINDOW_WORDS]) for i in range(0, len(w), WINDOW_WORDS)]


def spread(text: str, share: float) -> str:
    """``text``, or that share of its windows from all over it."""
    if share >= 1:
        return text
    w = windows(text)
    return b"".join(evenly(w, max(1, int(share * len(w))))).decode()


def evenly(w: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` of the windows, from all over the text."""
    keep = min(most, len(w))
    return [w[i * len(w) // keep] for i in range(keep)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=plain)


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """Trained dictionary; the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _grams(text: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - size + 1)
    return sum((raw[k:k + n] << np.uint64(8 * k) for k in range(size)), np.zeros(n, np.uint64))


def _telling(toxic: list[bytes], ordinary: list[bytes], size: int) -> np.ndarray:
    """Grams that tell toxic documents from ordinary ones."""
    grams, often = np.unique(np.concatenate(
        [np.unique(_grams(t, size)) for t in toxic] or [np.zeros(0, np.uint64)]), return_counts=True)
    rate = often / max(1, len(toxic))
    common = (often >= MIN_DOCS) & (rate >= MIN_SHARE)
    grams, rate = grams[common], rate[common]
    there = np.zeros(len(grams))
    for t in ordinary if len(grams) else ():
        here = np.unique(_grams(t, size))
        at = np.minimum(np.searchsorted(grams, here), len(grams) - 1)
        there[at[grams[at] == here]] += 1
    share = (there + 1) / max(1, len(ordinary))
    return grams[rate >= MIN_RATIO * share]


def _spans(text: bytes, telling: dict[int, np.ndarray]) -> list[bytes]:
    """Runs of ``text`` covered by telling grams."""
    cover = np.zeros(len(text) + 2, bool)
    for size, grams in telling.items():
        hit = np.isin(_grams(text, size), grams)
        for k in range(size):
            cover[1 + k:1 + k + len(hit)] |= hit
    edge = np.flatnonzero(cover[1:] != cover[:-1])
    return [text[a:b].strip() for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(6))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    bias: float = -np.inf

    def measure(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 6) features."""
        plain, both = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        out = np.zeros((len(texts), 6))
        for i, text in enumerate(texts):
            w = windows(text)
            if w:
                saved = np.array([len(plain.compress(x)) - len(both.compress(x)) for x in w])
                out[i, :4] = [(saved >= t).mean() for t in (1, 2, 3, 4)]
                out[i, 4] = min(10, saved.max()) / 10
                out[i, 5] = np.log(len(w)) / 8
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not np.isfinite(self.bias):  # nothing learned
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(self.measure(texts)), -40, 40)))

    def fit(self, features: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic curve, then the threshold of the best F1."""
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-9
        x = np.column_stack([(features - self.mean) / self.scale, np.ones(len(y))])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (p - y) + 0.5 * w)
        self.weights, self.bias = w[:-1], float(w[-1])
        z = x @ w
        order = np.argsort(-z)
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        k = int(f1.argmax())
        below = z[order[k + 1]] if k + 1 < len(y) else z[order[k]] - 1
        self.bias -= (z[order[k]] + below) / 2


def _with_dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    joined = [[b" %b " % b" ".join(words(t)) for t in texts] for texts in (toxic, ordinary)]
    telling = {n: _telling(*joined, n) for n in GRAMS}
    samples = []
    for text in joined[0]:
        spans = _spans(text, telling)
        samples += [b" %b " % b" ".join(spans[i:i + 8]) for i in range(0, len(spans), 8)]
    return ToxicityModel(
        _trained(ORDINARY_BYTES, [w for t in ordinary for w in evenly(windows(t), ORDINARY_WINDOWS)], 32),
        _trained(TOXIC_BYTES, samples, SEGMENT))


def _halves(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Half of each (kind, key) of the sampled rows, in turn by key."""
    keys = sorted((r.toxic, r.k) for r in rows.select("toxic", "k").distinct().collect())
    toxic = sum(kind for kind, _ in keys)
    return {key: (n if key[0] == 0 else n - len(keys) + toxic) % 2 for n, key in enumerate(keys)}


def _training_texts(rows: DataFrame) -> list:
    """Sampled rows with the part of their text that dictionaries see."""
    shares = {
        r.toxic: min(1.0, TRAIN_BYTES / r.size)
        for r in rows.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("size")).collect()}

    @F.arrow_udf("string")
    def part(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([spread(t, shares[y]) for y, t in zip(kinds.to_pylist(), texts.to_pylist())], pa.string())

    text = F.col("text") if min(shares.values(), default=1) == 1 else part("toxic", "text")
    return sorted(rows.select("toxic", "k", text.alias("text")).collect())


def _measured(rows: DataFrame, models: list[ToxicityModel], halves: dict) -> list:
    """Sampled rows with the features of their whole text, each by the model
    of the other half."""

    @F.arrow_udf("array<double>")
    def run(kinds: pa.Array, keys: pa.Array, texts: pa.Array) -> pa.Array:
        half = np.array([halves[key] for key in zip(kinds.to_pylist(), keys.to_pylist())], int)
        texts = np.array(texts.to_pylist(), object)
        out = np.zeros((len(texts), 6))
        for h in (0, 1):
            out[half == h] = models[1 - h].measure(texts[half == h].tolist())
        return pa.array(out.tolist(), pa.list_(pa.float64()))

    return sorted(rows.select("toxic", "k", run("toxic", "k", "text").alias("features")).collect())


def train(rows: DataFrame) -> ToxicityModel:
    """Dictionaries from all rows (toxic, k, text); the curve from each half's
    distances to dictionaries of the other half."""
    halves = _halves(rows)
    if {(kind, half) for (kind, _), half in halves.items()} != {(0, 0), (0, 1), (1, 0), (1, 1)}:
        return ToxicityModel()
    texts = _training_texts(rows)

    def of(kind: int, half: int | None = None) -> list[str]:
        return [r.text for r in texts if r.toxic == kind and half in (None, halves[r.toxic, r.k])]

    measured = _measured(rows, [_with_dictionaries(of(1, h), of(0, h)) for h in (0, 1)], halves)
    model = _with_dictionaries(of(1), of(0))
    model.fit(np.array([r.features for r in measured]), np.array([float(r.toxic) for r in measured]))
    return model


def train_model(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Model from bounded samples of labelled rows (doc_id, toxic)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    sample = (
        bounded_sample(known.filter("toxic = 1"), F.col("doc_id"), TRAIN_TOXIC)
        .unionByName(bounded_sample(known.filter("toxic = 0"), F.col("doc_id"), TRAIN_ORDINARY)))
    rows = materialize(
        docs.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")  # a bounded sample
        .select(F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("k"), "text")
        .filter(F.col("text") != ""), "toxicity-sample")
    model = train(rows)
    release(rows)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column ``out`` in 0..1."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts.to_pylist()), pa.float64())

    return docs.withColumn(out, run(F.col(text_col)))


@register("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train_model(docs, labels.filter(~held_out))
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
