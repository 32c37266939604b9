"""Language identification by a byte convolutional network.

A text's UTF-8 bytes (A-Z lower-cased) are cut into fixed-length windows.
Filters of several widths slide over a window, each keeps its largest response
(max pooling), and a softmax over those gives the window's probabilities; a
text's probabilities are the mean over its windows, weighted by their bytes.
The last, partly filled window is padded with a byte of its own.

The network is trained in numpy on the driver, on at most ``TRAIN_ROWS``
windows of labelled text (``bounded_sample``); filters over one-hot bytes are
tables, so a filter's response is a sum of looked-up rows.  For inference,
pairs of byte rows are summed beforehand, which halves the look-ups.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any labelled text every text is ``und``; ties go to the first language
in order; every input row gives one output row, other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back
from .registry import load, register
from .sample import bounded_sample, fold

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
TRAIN_ROWS = 6_000
EPOCHS = 12
BATCH_BYTES = 1 << 16  # bytes of windows scored at once
SLICE_CHARS = 1 << 19  # characters of texts cut into windows at once
PAD = 0x20
UNKNOWN = "und"


def _fold_case() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class ByteNet:
    """Filters by width: tables[w] is (w, 256, FILTERS), bias[w] (FILTERS,)."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.pairs: np.ndarray | None = None

    def responses(self, x: np.ndarray, w: int) -> np.ndarray:
        """(rows, positions, FILTERS) responses of windows ``x`` (rows, WINDOW)."""
        n = x.shape[1] - w + 1
        t = self.tables[w]
        return sum(t[j][x[:, j:j + n]] for j in range(w)) + self.bias[w]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam on softmax cross-entropy; through max pooling a filter's
        gradient reaches only the bytes under its largest response."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), *self.bias.values(), self.out, self.out_bias]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        step, k = 0, len(WIDTHS)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                rows = order[at:at + 64]
                xb, best, feats = x[rows], [], []
                for w in WIDTHS:
                    r = self.responses(xb, w)
                    best.append(r.argmax(axis=1))
                    feats.append(np.take_along_axis(r, best[-1][:, None], 1)[:, 0])
                raw = np.concatenate(feats, 1)
                h = np.maximum(raw, 0)
                p = _softmax(h @ self.out + self.out_bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                dh = (p @ self.out.T) * (raw > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[w])
                    d = dh[:, i * FILTERS:(i + 1) * FILTERS]
                    cols = np.broadcast_to(np.arange(FILTERS), d.shape)
                    for j in range(w):
                        byte = np.take_along_axis(xb, best[i] + j, 1)
                        np.add.at(g[j], (byte, cols), d)
                    grads.append(g)
                grads += [dh[:, i * FILTERS:(i + 1) * FILTERS].sum(0) for i in range(k)]
                grads += [h.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, languages) probabilities of windows."""
        if self.pairs is None:
            t2, t3, t4 = (self.tables[w] for w in WIDTHS)
            both = [t2[0][:, None] + t2[1][None], t3[0][:, None] + t3[1][None],
                    t4[0][:, None] + t4[1][None]]
            self.pairs = np.concatenate(both, 2).reshape(65536, -1)
            self.tail = (t4[2][:, None] + t4[3][None]).reshape(65536, -1)
        code = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        r = self.pairs[code]
        f = FILTERS
        r[:, :-1, f:2 * f] += self.tables[3][2][x[:, 2:]]
        r[:, :-2, 2 * f:] += self.tail[code[:, 2:]]
        h = np.concatenate([
            r[:, :, :f].max(1) + self.bias[2], r[:, :-1, f:2 * f].max(1) + self.bias[3],
            r[:, :-2, 2 * f:].max(1) + self.bias[4]], 1)
        return _softmax(np.maximum(h, 0) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts (rows, WINDOW) and how many each text has."""
    table = _fold_case()
    raws = [t.encode().translate(table) for t in texts]
    counts = np.array([max(1, -(-len(r) // WINDOW)) for r in raws])
    flat = b"".join(
        r.ljust(int(c) * WINDOW, bytes([PAD])) for r, c in zip(raws, counts))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), counts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train_network(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> ByteNet:
    """Network trained on a bounded sample: a window's length of characters
    from a hashed place in each sampled text."""
    rows = docs.filter(F.col(lang_col).isNotNull())
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)),
                F.greatest(F.lit(1), F.char_length(text_col) - F.lit(WINDOW)).cast("long"))
    cut = rows.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
        F.substring(F.col(text_col), (at + 1).cast("int"), F.lit(WINDOW)).alias("text"))
    got = bounded_sample(cut, F.col("id"), TRAIN_ROWS).filter(F.col("text").rlike(r"\p{L}")).collect()
    languages = sorted({r.lang for r in got})
    net = ByteNet(languages)
    if got:
        x, counts = windows([r.text for r in got])
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        net.train(x[first], np.array([languages.index(r.lang) for r in got]))
    return net


def identify(docs: DataFrame, net: ByteNet, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: ``lang`` and ``score``."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        langs, scores, held, size = [], [], [], 0
        n = max(1, BATCH_BYTES // WINDOW)

        def flush():
            x, counts = windows(held)
            p = np.concatenate([net.scores(x[k:k + n]) for k in range(0, len(x), n)])
            filled = np.concatenate([
                [WINDOW] * (c - 1) + [max(1, len(t.encode()) - WINDOW * (c - 1))]
                for t, c in zip(held, counts.tolist())])
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(p * filled[:, None], first) / np.add.reduceat(filled, first)[:, None]
            langs.extend(net.languages[k] for k in mean.argmax(1))
            scores.extend(np.clip(mean.max(1), 0, 1).tolist())
            held.clear()

        known = []
        for t in texts:
            text = t.as_py()
            known.append(bool(net.languages) and text is not None and has_letter(text))
            if known[-1]:
                held.append(text)
                size += len(text)
                if size > SLICE_CHARS:
                    flush()
                    size = 0
        if held:
            flush()
        found = iter(zip(langs, scores))
        both = [next(found) if k else (UNKNOWN, 0.0) for k in known]
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array([b[0] for b in both], pa.string()),
             pa.array([b[1] for b in both], pa.float64())], ["lang", "score"])

    once = run.asNondeterministic()  # a filter on the result must not run the network again
    return docs.withColumn(out, once(F.col(text_col)))


@register("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    net = train_network(docs.filter(~held_out))
    return identify(docs.drop("lang"), net).select(
        "doc_id", held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
