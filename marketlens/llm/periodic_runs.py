"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) that no neighbouring word extends, of at least ``MIN_LENGTH`` words
and ``MIN_EXPONENT`` periods.  A run's words after its first period say
nothing new: ``collapse_runs`` drops them.

For each scale t = 1, 2, 4, ... runs of periods t to 2t - 1 are looked for:

* Fragments of t words get exact names by prefix doubling (the name of 2t words
  is the rank of a pair of names), so equal names mean equal words.
* Position i is in the synchronising set when the least hashed name among the
  fragments at i ... i + t belongs to the first or the last of them.  Whether
  it is depends on words i ... i + 2t - 1 only, so equal contexts are chosen
  alike.  Fragments of a period of at most t/3 are not candidates.
* Those highly periodic fragments are detected apart: the next place of a
  fragment's first half gives its period, which names confirm over the whole.
  Runs of such small periods are found at their own, smaller scales.
* Of a run of period q in [t, 2t) and at least 4q words, no 3t - 1 words are
  highly periodic (the run's smallest period would be smaller), so one of its
  first t positions i is in the set; i + q has the same 2t words, is in the set
  as well and is the next such place, as a nearer one would give a smaller
  period.  Hence pairs of consecutive equal contexts at a distance in [t, 2t)
  propose the periods of all runs.
* A proposal is extended word by word in both directions, unless a run of that
  period already covers it, and kept when it is long enough.

All texts of a slice are worked on together.  A text without two equal
contexts of 2t words has no run of a period of t or more and leaves.

Defined results: null, empty and blank texts have no words and no runs; a text
that occurs twice is reported for each row; other columns pass through; every
text is read whole.  Memory is about 150 bytes a word of the slice, or of the
longest text if that is larger than a slice.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import load, register

MIN_LENGTH = 6
MIN_EXPONENT = 4
SLICE_CHARS = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)


def _hashed(names: np.ndarray, t: int) -> np.ndarray:
    """Pseudo-random order of names."""
    x = names.astype(np.uint64) + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names 0, 1, ... of equal keys, and the places ordered by key, then place."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), np.int64)
    new[:1] = 0
    np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
    names = np.empty(len(keys), np.int64)
    names[order] = new
    return names, order


def _shifted(values: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full(len(values), fill, values.dtype)
    if by < len(values):
        out[:len(values) - by] = values[by:]
    return out


class _Names:
    """Names of the fragments of t words at every place; -1 where the text
    ends before the fragment does."""

    def __init__(self, words: np.ndarray, room: np.ndarray):
        self.t = 1
        self.names = words
        self.order = np.argsort(words, kind="stable")
        self.room = room  # words from a place to the end of its text

    def doubled(self) -> "_Names":
        out = object.__new__(_Names)
        out.t, out.room = 2 * self.t, self.room
        second = _shifted(self.names, self.t, -1)
        size = np.int64(int(self.names.max(initial=0)) + 2)
        keys = (self.names + 1) * size + second + 1
        keys[self.room < out.t] = -1
        names, out.order = _ranks(keys)
        names[self.room < out.t] = -1
        out.names = names
        return out

    def next_equal(self, among: np.ndarray | None = None) -> np.ndarray:
        """Distance to the next place (of those ``among``) of the same name; 0
        if there is none.  Names of different texts never meet: a name's
        places are taken in order and ``room`` tells where a text ends."""
        order = self.order
        keep = self.names[order] >= 0
        if among is not None:
            keep &= among[order]
        order = order[keep]
        same = self.names[order[1:]] == self.names[order[:-1]]
        gap = order[1:] - order[:-1]
        same &= gap < self.room[order[:-1]]
        out = np.zeros(len(self.names), np.int64)
        out[order[:-1][same]] = gap[same]
        return out


def _highly_periodic(half: _Names, room: np.ndarray) -> np.ndarray:
    """Places whose fragment of t = 2 * half.t words has a period of at most t/3."""
    t = 2 * half.t
    gap = half.next_equal()
    near = np.flatnonzero((gap > 0) & (3 * gap <= t) & (room >= t))
    later = near + half.t
    out = np.zeros(len(room), bool)
    out[near[half.names[later - gap[near]] == half.names[later]]] = True
    return out


def _synchronising(names: _Names, dense: np.ndarray | None) -> np.ndarray:
    """Places in the synchronising set of scale t."""
    t, n = names.t, len(names.names)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = _hashed(names.names, t) >> np.uint64(1)
    value[names.names < 0] = top
    if dense is not None:
        value[dense] = top
    least, width = value, 1
    while width < t:
        least = np.minimum(least, _shifted(least, width, top))
        width *= 2
    least = np.minimum(least, _shifted(value, t, top))
    found = (least < top) & ((least == value) | (least == _shifted(value, t, top)))
    return found & (names.room >= 2 * t)


def _proposals(words: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) per scale, for texts of ``sizes`` words laid end to
    end in ``words``."""
    out = []
    at = np.arange(len(words))
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    room = begin[text] + sizes[text] - at
    half, names = None, _Names(words, room)
    while len(at) and int(names.room.max()) >= MIN_EXPONENT * names.t:
        t = names.t
        contexts = names.doubled()
        repeated = contexts.next_equal() > 0
        alive = np.zeros(len(sizes), bool)
        alive[text[repeated]] = True
        dense = _highly_periodic(half, names.room) if t >= 4 else None
        chosen = _synchronising(names, dense)
        gap = contexts.next_equal(chosen)
        hit = np.flatnonzero((gap >= t) & (gap < 2 * t))
        if len(hit):
            out.append((at[hit], gap[hit]))
        half, names = names, contexts
        stay = alive[text]
        if not stay.all():
            kept = np.flatnonzero(stay)
            at, text = at[kept], text[kept]
            for level in (half, names):
                places = np.cumsum(stay) - 1
                order = level.order[stay[level.order]]
                level.order, level.names, level.room = places[order], level.names[kept], level.room[kept]
    return out


def _reach(words: np.ndarray, a: int, q: int, end: int) -> int:
    """First place x >= a with words[x] != words[x + q], at most end - q."""
    step = 64
    while a < end - q:
        b = min(a + step, end - q)
        bad = np.flatnonzero(words[a:b] != words[a + q:b + q])
        if len(bad):
            return a + int(bad[0])
        a, step = b, 2 * step
    return end - q


def _reach_back(words: np.ndarray, a: int, q: int, begin: int) -> int:
    """Least x such that words[x:a] equal words[x + q:a + q]."""
    step = 64
    while a > begin:
        b = max(begin, a - step)
        bad = np.flatnonzero(words[b:a] != words[b + q:a + q])
        if len(bad):
            return b + int(bad[-1]) + 1
        a, step = b, 2 * step
    return begin


def runs_of_texts(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    known: dict[str, int] = {}
    sizes = np.array([len(w) for w in texts], np.int64)
    words = np.fromiter(
        (known.setdefault(w, len(known)) for ws in texts for w in ws), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for places, periods in _proposals(words, sizes):
        owners = np.searchsorted(ends, places, "right")
        covered: dict[int, int] = {}  # period -> end of the last stretch looked at
        for a, q, k in zip(places.tolist(), periods.tolist(), owners.tolist()):
            begin, end = int(ends[k] - sizes[k]), int(ends[k])
            if a + q < covered.get(q, 0):
                continue
            start = _reach_back(words, a, q, begin)
            stop = _reach(words, a, q, end) + q
            covered[q] = stop
            if stop - start >= max(MIN_LENGTH, MIN_EXPONENT * q):
                out[k].append((start - begin, stop - start, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Words that lie in no run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(edge).tolist()) if not n]


_RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW_RESULT = pa.struct([("runs", pa.list_(_ARROW_RUN)), ("collapsed", pa.string())])


def _find(texts: pa.Array) -> pa.Array:
    out, held, size = [], [], 0

    def flush() -> None:
        split = [_WORD.findall(t) for t in held]
        for words, runs in zip(split, runs_of_texts(split)):
            out.append({
                "runs": [dict(zip(("start", "length", "period"), r)) for r in runs],
                "collapsed": " ".join(kept_words(words, runs))})
        held.clear()

    for t in texts:
        text = t.as_py() or ""
        if held and size + len(text) > SLICE_CHARS:
            flush()
            size = 0
        held.append(text)
        size += len(text)
    if held:
        flush()
    return pa.array(out, _ARROW_RESULT)


_find.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def collapse_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic") -> DataFrame:
    """``docs`` with a struct column ``out``: ``runs`` (by start, then period)
    and ``collapsed``, the text's kept words joined by one space."""
    return docs.withColumn(out, F.arrow_udf(_find, _RESULT)(F.col(text_col)))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) ends in 0, a text's words from the
    a-th on become repetitions of the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(
        h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    places = words.select("*", F.size("w").alias("n"), (F.col("g") % F.nullif(F.size("w"), F.lit(0))).alias("a"))
    left = F.col("n") - F.col("a")
    places = places.withColumn("p", F.lit(1) + F.floor(left / (F.lit(3) + F.col("g") % 8)))
    unit = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left.cast("int"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return places.select("doc_id", F.coalesce(planted, F.col("text")).alias("text"))


@register("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = collapse_runs(with_planted_runs(docs)).select("doc_id", "periodic.*")
    # Lengths and periods are below 2**31, so their products fit a bigint.
    best = F.reduce(
        "runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda b, r: F.when(
            b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"),
        F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
