"""Benchmark decontamination: near copies of benchmark items inside documents.

Texts are sequences of words (Unicode lower case; runs of letters, digits and
non-ASCII characters, but single characters in scripts written without
spaces), so case, punctuation and line breaks do not matter.  A document leaks
an item of n words when some run of its words is within edit distance
floor(``TOLERANCE`` * n) of it.

* CGK embedding: a pointer walks over a window's words; at every step the word
  under it is written down, and a random bit of (step, word) says whether the
  pointer moves on.  Two windows a few edits apart soon walk in step again, so
  their embeddings differ in few places: edit distance becomes Hamming distance.
* Bit sampling: a table's key is the hash of ``SAMPLES`` places of an embedding.
  An item is embedded from its windows of 5, 8 or 16 words (``WINDOWS``, by the
  item's length; at most ``ANCHORS`` windows, evenly spaced), any of which may
  match; a document from every word.  A walk has as many steps as the
  window has words.  Only item keys of ``SAMPLES`` different words are kept.
* How many walks and tables a window size needs is found by embedding simulated
  copies at the tolerance (deletions, insertions, replacements, clusters) of its
  hardest item lengths, until ``RECALL`` of each kind is found, and half as many
  tables again (``tables_of``).
* A key found sets the item's place there; the leak begins and ends within
  the tolerance of it.  Places whose surroundings overlap are taken together, and
  each candidate is verified by the exact edit distance of the item to the
  best-fitting run of words around its places.
* Items of 4 to 7 words leak where their words occur one after the other, found
  by the hash of the whole; items of fewer words leak only if they are the whole
  document, as a word or two in a row is no evidence.

Items are the stated query set.  They are taken in blocks of at most
``BLOCK_ITEMS``, and each block's words and keys (8 bytes a word, 16 a key)
travel with one function; each block is a pass over the documents' words, and
documents are never shuffled.

Defined results: null items and items without words leak nowhere; null and
empty documents leak nothing but equal the empty item, which is none; an item
or document that occurs twice is reported for each row; every document is read
whole.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_jaccard import _mix
from .memory import give_back
from .registry import load, register

TOLERANCE = 0.2
NEAR_WORDS = 8   # items from here on leak by near copies,
EXACT_WORDS = 4  # from here on by exact ones
WINDOWS = ((15, 5), (30, 8), (1 << 62, 16))  # (items under so many words, words of their windows)
ANCHORS = 32     # windows of an item at most
SAMPLES = 3
TABLES_OF_A_WALK = 8
RECALL = 0.98
MAX_TABLES = 60
BLOCK_ITEMS = 2_000
SLICE_CHARS = 1 << 20
CHUNK = 1 << 15  # words embedded at once, so that arrays stay in the cache

_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_POWER = np.uint64(0xE7037ED1A0B428DB)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _unspaced(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters of scripts without spaces begin in UTF-8 bytes, and
    where they end: U+0E00-0EFF (Thai, Lao), U+1000-109F (Myanmar), U+1780-17FF
    (Khmer), U+3000-9FFF and U+20000-3FFFF (Han, kana)."""
    second = np.append(raw[1:], 0)
    three = (((raw == 0xE0) & (second >= 0xB8) & (second <= 0xBB)) | ((raw == 0xE1) & (second >= 0x80) & (second <= 0x82))
             | ((raw == 0xE1) & (second >= 0x9E) & (second <= 0x9F)) | ((raw >= 0xE3) & (raw <= 0xE9)))
    four = (raw == 0xF0) & (second >= 0xA0) & (second <= 0xBF)
    begins = three | four
    ends = np.zeros(len(raw) + 4, bool)
    ends[np.flatnonzero(three) + 3] = True
    ends[np.flatnonzero(four) + 4] = True
    return begins, ends[:len(raw)]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (and end)."""
    raws = [(t or "").lower().encode("utf-8", "replace") + b"\n" for t in texts]
    begin = np.cumsum([0] + [len(r) for r in raws])
    raw = np.frombuffer(b"".join(raws), np.uint8)
    word = _IS_WORD[raw]
    new = word.copy()
    new[1:] &= ~word[:-1]
    if raw.max(initial=0) >= 0xE0:
        begins, ends = _unspaced(raw)
        new |= word & (begins | ends)
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(word)
    first = np.flatnonzero(new[at])
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    powers = np.ones(int(sizes.max()), np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, _POWER))
    hashes = _mix(np.add.reduceat(_BYTES[raw[at]] * powers[place], first))
    return hashes, np.searchsorted(starts, begin)


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _POWER + words[k:k + n]
    return _mix(out)


def tolerated(n: int) -> int:
    """Edits at which a run still counts as a copy of an item of n words."""
    return int(TOLERANCE * n)


# --- CGK walks and bit-sampled tables ---------------------------------------------------

def embedded(words: np.ndarray, walk: int, steps: int, begin: int = 0, end: int | None = None
             ) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The walk's embedding from each word of a range, and its pointer: the
    word under the pointer at each step (null words behind the end)."""
    end = len(words) if end is None else end
    padded = words[begin:end + steps]
    if end + steps > len(words):
        padded = np.concatenate([padded, np.zeros(end + steps - len(words), np.uint64)])
    # One bit a step of each word's hash says whether the pointer moves on.
    moves = _mix(padded + np.uint64((walk + 1) * 0x9E3779B97F4A7C15 % 2**64)).astype(np.uint32)
    pointer, out, pointers = np.arange(end - begin, dtype=np.int64), [], []
    for step in range(steps):
        out.append(padded.take(pointer, mode="clip"))
        pointers.append(pointer)
        pointer = pointer + (moves.take(pointer, mode="clip") >> np.uint32(step) & np.uint32(1))
    return out, pointers


def sampled(embedding: list[np.ndarray], table: tuple[int, ...]) -> np.ndarray:
    """A table's keys: hashes of the sampled places."""
    key = embedding[table[0]] * _POWER
    for step in table[1:]:
        key += embedding[step]
        key *= _POWER
    return key ^ (key >> np.uint64(29))


def telling(pointers: list[np.ndarray], table: tuple[int, ...], last: np.ndarray) -> np.ndarray:
    """Keys whose samples are different words before ``last``; others would
    match wherever one or two words recur."""
    ok = pointers[table[-1]] < last
    for a, b in zip(table[:-1], table[1:]):
        ok &= pointers[a] < pointers[b]
    return ok


def _tables(window: int, count: int) -> list[tuple[int, tuple[int, ...]]]:
    """``count`` tables (walk, sampled steps) of a window size."""
    rng = random.Random(window)
    return [(t // TABLES_OF_A_WALK, tuple(sorted(rng.sample(range(window), SAMPLES)))) for t in range(count)]


def anchors(n: int, window: int) -> range:
    """Where the windows of an item of n words begin."""
    return range(0, n - window + 1, -(-(n - window + 1) // ANCHORS))


def _copies(window: int, length: int, kind: str, count: int) -> list[tuple[list[int], list[int]]]:
    """Simulated items of distinct words and their copies at the tolerance."""
    rng = random.Random(f"{window} {length} {kind}")
    fresh = functools.partial(rng.getrandbits, 62)
    out = []
    for _ in range(count):
        item = [fresh() for _ in range(length)]
        copy, k = list(item), tolerated(length)
        if kind == "cluster":
            at = rng.randrange(length - k + 1)
            copy[at:at + k] = [fresh() for _ in range(k)]
        else:
            for at in sorted(rng.sample(range(length), k), reverse=True):
                copy[at:at + 1] = {"delete": [], "insert": [item[at], fresh()], "replace": [fresh()]}[kind]
        out.append((item, [*copy, *(fresh() for _ in range(2 * window))]))
    return out


@functools.cache
def tables_of(window: int) -> list[tuple[int, tuple[int, ...]]]:
    """The tables of a window size, as many as ``RECALL`` takes."""
    least = dict(zip((w for _, w in WINDOWS), (NEAR_WORDS, *(n for n, _ in WINDOWS))))[window]
    # Edits grow with every fifth word, so these lengths are the hardest ones.
    lengths = sorted({least, *(n for n in range(least, least + 16) if n % 5 == 0)})
    groups, items, copies = [], [], []
    for length in lengths:
        for kind in ("delete", "insert", "replace", "cluster"):
            for item, copy in _copies(window, length, kind, 100):
                groups.append((length, kind))
                items.append(np.array(item, np.uint64))
                copies.append(np.array(copy, np.uint64))
    sides = []
    for side, texts in enumerate((items, copies)):
        words = np.concatenate([part for t in texts for part in (t, np.zeros(window, np.uint64))])
        begin = np.cumsum([0] + [len(t) + window for t in texts])[:-1]
        at = [b + np.arange(len(t)) if side else b + np.array(anchors(len(t), window)) for b, t in zip(begin, texts)]
        owner = np.repeat(np.arange(len(texts)), [len(a) for a in at])
        last = (begin + [len(t) for t in texts])[owner]
        sides.append((words, np.concatenate(at), owner, last))
    found = np.zeros(len(groups), bool)
    names = sorted(set(groups))
    group = np.array([names.index(g) for g in groups])
    each = np.bincount(group)
    every = _tables(window, MAX_TABLES)
    for t, (walk, table) in enumerate(every):
        keys = []
        for words, at, owner, last in sides:
            walked, pointers = embedded(words, walk, window)
            key = _mix(sampled([e[at] for e in walked], table) + owner.astype(np.uint64))
            ok = telling([p[at] for p in pointers], table, last)
            keys.append((key[ok], owner[ok]))
        found[keys[0][1][np.isin(keys[0][0], keys[1][0])]] = True
        if (np.bincount(group, found) / each).min() >= RECALL:
            break
    return _tables(window, min(MAX_TABLES, -(-3 * (t + 1) // 2)))


class Keys:
    """Sorted keys and where each one's window lies in its item."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, offsets: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.offsets = keys[order], items[order], offsets[order]
        bits = min(24, max(12, (16 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.keys >> self.shift] = True

    def matches(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ``key`` that are known, their items, and where those
        would begin."""
        at = np.flatnonzero(self.maybe[key >> self.shift])
        lo = np.searchsorted(self.keys, key[at], "left")
        n = np.searchsorted(self.keys, key[at], "right") - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        return at, self.items[which], at - self.offsets[which]


class LeakIndex:
    """Words and keys of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        hashes, begin = word_hashes(texts)
        self.words = [hashes[a:b] for a, b in zip(begin[:-1], begin[1:])]
        self.sizes = np.diff(begin)
        self.ids = ids
        n = self.sizes
        self.near: list[tuple[int, int, list[tuple[tuple[int, ...], Keys]]]] = []  # steps, walk, its tables
        least = NEAR_WORDS
        for below, window in WINDOWS:
            mine = np.flatnonzero((n >= least) & (n < below))
            least = below
            if len(mine):
                self._add_walks(window, mine)
        self.exact = []  # words, keys of items of so many words
        for size in range(EXACT_WORDS, NEAR_WORDS):
            mine = np.flatnonzero(n == size)
            if len(mine):
                keys = np.array([_runs(self.words[i], size)[0] for i in mine], np.uint64)
                self.exact.append((size, Keys(keys, mine, np.zeros(len(mine), np.int64))))
        self.whole: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((n > 0) & (n < EXACT_WORDS)).tolist():
            self.whole.setdefault(self.words[i].tobytes(), []).append(i)

    def _add_walks(self, window: int, items: np.ndarray) -> None:
        """Tables of the items' windows, laid end to end with a gap."""
        at, owner, offset, last, parts, begin = [], [], [], [], [], 0
        for i in items.tolist():
            places = np.array(anchors(len(self.words[i]), window))
            at.append(begin + places)
            offset.append(places)
            owner.append(np.full(len(places), i))
            parts += [self.words[i], np.zeros(window, np.uint64)]
            last.append(np.full(len(places), begin + len(self.words[i])))
            begin += len(self.words[i]) + window
        words, at, owner, offset, last = map(np.concatenate, (parts, at, owner, offset, last))
        tables = tables_of(window)
        for walk in sorted({w for w, _ in tables}):
            walked, pointers = embedded(words, walk, window)
            walked, pointers = [e[at] for e in walked], [p[at] for p in pointers]
            known = []
            for w, table in tables:
                if w == walk:
                    ok = telling(pointers, table, last)
                    known.append((table, Keys(sampled(walked, table)[ok], owner[ok], offset[ok])))
            self.near.append((window, walk, known))

    def _matches(self, words: np.ndarray):
        for begin in range(0, len(words), CHUNK):
            end = min(len(words), begin + CHUNK)
            for steps, walk, tables in self.near:
                walked = embedded(words, walk, steps, begin, end)[0]
                for table, keys in tables:
                    at, items, places = keys.matches(sampled(walked, table))
                    yield at + begin, items, places + begin
        for size, keys in self.exact:
            yield keys.matches(_runs(words, size))

    def candidates(self, words: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, least and largest place of the item) of keys found
        among ``words``, where texts begin at ``begin``."""
        if not self.near and not self.exact:
            return []
        at, item, place = map(np.concatenate, zip(*self._matches(words)))
        if not len(at):
            return []
        text = np.searchsorted(begin, at, "right") - 1
        order = np.lexsort((place, item, text))
        text, item, place = text[order], item[order], place[order]
        size = self.sizes[item[1:]]
        apart = np.diff(place) > size + 2 * (TOLERANCE * size).astype(np.int64)
        new = np.flatnonzero(np.diff(text).astype(bool) | np.diff(item).astype(bool) | apart) + 1
        first = np.concatenate([[0], new])
        last = np.concatenate([new, [len(at)]]) - 1
        return list(zip(text[first].tolist(), item[first].tolist(), place[first].tolist(), place[last].tolist()))

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int]]]:
        """Per text: (item id, first word, words of the item, distance)."""
        hashes, begin = word_hashes(texts)
        padded, at = _spaced(hashes, begin)
        sizes = np.diff(begin)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if self.whole:
            for o, a, b in zip(out, begin[:-1], begin[1:]):
                if b - a < EXACT_WORDS:
                    o.update(dict.fromkeys(self.whole.get(hashes[a:b].tobytes(), ()), (0, 0)))
        for text, item, least, largest in self.candidates(padded, at):
            words = self.words[item]
            most = tolerated(len(words)) if len(words) >= NEAR_WORDS else 0
            lo = max(int(at[text]), least - most)
            hi = min(int(at[text] + sizes[text]), largest + len(words) + most)
            region = padded[lo:hi]
            if np.isin(words, region).sum() < len(words) - most:
                continue
            distance, end = fit_distance(words, region)
            if distance <= most and distance < out[text].get(item, (most + 1, 0))[0]:
                out[text][item] = (distance, max(0, lo - int(at[text]) + end - len(words)))
        return [
            [(self.ids[i], place, len(self.words[i]), d) for i, (d, place) in sorted(o.items())]
            for o in out
        ]


def _spaced(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' words with a gap of one null word after each, and where each
    text begins there."""
    n = len(begin) - 1
    out = np.zeros(len(hashes) + n, np.uint64)
    text = np.repeat(np.arange(n), np.diff(begin))
    out[np.arange(len(hashes)) + text] = hashes
    return out, begin[:-1] + np.arange(n)


def fit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any run of ``region``, and where the
    best run ends."""
    along = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item.tolist(), 1):
        nxt = np.empty_like(row)
        nxt[0] = i
        nxt[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != np.uint64(word)))
        row = np.minimum.accumulate(nxt - along) + along
    end = int(row.argmin())
    return int(row[end]), end


_LEAK = "array<struct<item_id:bigint,first_word:int,item_words:int,distance:int>>"
_ARROW_LEAK = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("first_word", pa.int32()), ("item_words", pa.int32()),
    ("distance", pa.int32())]))
_NAMES = ("item_id", "first_word", "item_words", "distance")


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "leaks",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` with an array column ``out`` of the items each leaks."""
    items = items.filter(F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, -(-items.count() // (BLOCK_ITEMS // 2)))
    parts = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r.i is None, r.i, r.t))
        index = LeakIndex([r.i for r in rows], [r.t for r in rows])
        part = f"_leaks{b}"
        once = F.arrow_udf(_leak_function(index), _LEAK).asNondeterministic()  # also if the result is filtered
        docs = docs.withColumn(part, once(F.col(text_col)))
        parts.append(part)
    return docs.withColumn(out, F.concat(*parts)).drop(*parts)


def _leak_function(index: LeakIndex):
    def run(texts: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for t in texts:
            text = t.as_py()
            held.append(text)
            size += len(text or "")
            if size > SLICE_CHARS:
                out += index.leaks(held)
                held, size = [], 0
        if held:
            out += index.leaks(held)
        give_back()
        return pa.array([[dict(zip(_NAMES, x)) for x in row] for row in out], _ARROW_LEAK)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


@register("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    """One row per document and item it leaks."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.first_word", "leak.item_words", "leak.distance",
        (1 - F.col("leak.distance") / F.col("leak.item_words")).alias("similarity"))
