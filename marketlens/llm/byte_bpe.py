"""Byte-level BPE encoding and decoding over a public rank file.

A piece is one match of the tokenizer's pattern.  A segment tree over its byte
positions stores, for each live position, the rank of the pair it starts with;
its root is the leftmost pair of least rank.  A merge takes the root, joins two
live neighbours and makes three point updates (the pair that vanished, the
new pair, the pair before it), each logarithmic in the piece's length.  Short
pieces run through one tree array per length class, one merge of every piece
a step; long ones use a tree of their own.  A piece that is itself a token is
that token, as in the tiktoken library.

Pieces repeat, so a task remembers up to ``CACHE_PIECES`` of them and starts
anew when that is full; nothing is dropped.  The rank file is read on the
driver and travels with the function; its size is that of the vocabulary.

Defined results: null and empty texts have no ids and decode to no bytes;
every input row gives one output row; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back
from .registry import load, register

CACHE_PIECES = 200_000
SLICE_CHARS = 1_000_000  # characters cut into pieces at once
LANE_BYTES = 64  # pieces up to this length share a tree array
LANE_CELLS = 1 << 17  # bytes of such pieces in one array
_NONE = np.int64(1) << 62


class Vocabulary:
    """Tokens by id, and the id that each mergeable pair of ids makes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        pairs = sorted(
            (ranks[t[:k]] << 32 | ranks[t[k:]], i)
            for t, i in ranks.items() for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        )
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.made = np.array([i for _, i in pairs] or [0], np.int64)


class Encoder:
    """Encodes texts by a vocabulary; lives as long as a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(vocabulary.pattern)
        self.ids = {t: i for i, t in enumerate(vocabulary.tokens) if t}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}
        self._pairs: dict[int, int] | None = None

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, held, chars = [], [], 0
        for text in texts:
            text = text or ""
            if len(text) > SLICE_CHARS:
                out += self._join(held)
                matches = (m.group() for m in self.split.finditer(text))
                parts = iter(lambda: list(islice(matches, SLICE_CHARS // 4)), [])
                out.append(b"".join(self._join([part])[0] for part in parts))
                held, chars = [], 0
                continue
            held.append(self.split.findall(text))
            chars += len(text)
            if chars > SLICE_CHARS:
                out += self._join(held)
                held, chars = [], 0
        return out + self._join(held)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        token = self.v.tokens.__getitem__
        return b"".join(
            b"".join(map(token, ids[k:k + SLICE_CHARS].tolist()))
            for k in range(0, len(ids), SLICE_CHARS)
        )

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not remembered."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = pieces
        lanes: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode()
            i = self.ids.get(raw)
            if i is not None:
                self.known[p] = i.to_bytes(4, "little")
            elif len(raw) > LANE_BYTES:
                self.known[p] = self._one(raw)
            else:
                lanes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for width, rows in lanes.items():
            step = LANE_CELLS // width
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                for (p, _), ids in zip(part, self._lanes([r for _, r in part], width)):
                    self.known[p] = ids

    def _join(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as pieces."""
        self.learn(set().union(*texts))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in texts]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or ``_NONE >> 32``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.made[at], _NONE >> 32)

    def _lanes(self, raws: list[bytes], width: int) -> list[bytes]:
        """Encode pieces of up to ``width`` (a power of two) bytes, a merge of
        each at a time.  Tree rows: root at 1, leaves from ``width``; a leaf is
        rank << 32 | position."""
        n = len(raws)
        size = np.array([len(r) for r in raws], np.int64)
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8)
        ids = np.zeros((n, width + 1), np.int64)
        ids[:, :width] = self.byte_ids[flat].reshape(n, width)
        place = np.arange(width, dtype=np.int64)
        live = place < size[:, None]
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * width), _NONE)
        rank = self._pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        leaf = rank << 32 | place
        tree[:, width:] = np.where((place + 1 < size[:, None]) & (leaf < _NONE), leaf, _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(
                tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            go = root < _NONE
            rows, root = rows[go], root[go]
            if not len(rows):
                break
            p = root & 0xFFFFFFFF
            q = after[rows, p]
            nxt = after[rows, q]
            prev = before[rows, p]
            ids[rows, p] = root >> 32
            after[rows, p] = nxt
            before[rows, np.minimum(nxt, width)] = p
            live[rows, q] = False
            tree[rows, width + q] = _NONE
            has = nxt < size[rows]
            made = self._pair(ids[rows, p], ids[rows, np.minimum(nxt, width)])
            tree[rows, width + p] = np.where(
                has & (made < _NONE >> 32), made << 32 | p, _NONE)
            made = self._pair(ids[rows, np.maximum(prev, 0)], ids[rows, p])
            # Without a neighbour before it, the pair's own leaf is kept.
            back = prev >= 0
            tree[rows[back], width + prev[back]] = np.where(
                made[back] < _NONE >> 32, made[back] << 32 | prev[back], _NONE)
            nodes = [width + q, width + p, width + np.maximum(prev, 0)]
            for _ in range(width.bit_length() - 1):
                for k, node in enumerate(nodes):
                    nodes[k] = node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        packed = ids[:, :-1][live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live.sum(axis=1))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _one(self, raw: bytes) -> bytes:
        """Encode one long piece with a tree of its own."""
        if self._pairs is None:
            self._pairs = dict(zip(self.v.keys.tolist(), self.v.made.tolist()))
        pair, none = self._pairs, int(_NONE)
        n = len(raw)
        width = 1 << (n - 1).bit_length()
        ids = [int(self.byte_ids[b]) for b in raw]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def leaf(i: int, j: int) -> int:
            made = pair.get(ids[i] << 32 | ids[j]) if 0 <= i and j < n else None
            return none if made is None else made << 32 | i

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            p = tree[1] & 0xFFFFFFFF
            q = after[p]
            ids[p] = tree[1] >> 32
            ids[q] = -1
            after[p] = nxt = after[q]
            if nxt < n:
                before[nxt] = p
            prev = before[p]
            for i, value in ((q, none), (p, leaf(p, nxt)), (prev, leaf(prev, p))):
                if i >= 0:
                    node = width + i
                    tree[node] = value
                    while node > 1:
                        node >>= 1
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


def tokenize(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "bpe",
    decode: bool = True,
) -> DataFrame:
    """``docs`` with a struct column ``out``: ``ids`` (binary, little-endian
    unsigned 32-bit) and ``decoded`` (the bytes those ids stand for; null
    unless ``decode``)."""
    vocabulary = Vocabulary(path, pattern)
    made: list[Encoder] = []

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Encoder(vocabulary))
        encoder = made[0]
        ids = encoder.encode(t.as_py() for t in texts)
        back = [encoder.decode(i) if decode else None for i in ids]
        out = pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["ids", "decoded"])
        del ids, back
        give_back()
        return out

    return docs.withColumn(out, run(F.col(text_col)))


@register("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = tokenize(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("bpe.ids") / 4).alias("n_tokens"),
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )
