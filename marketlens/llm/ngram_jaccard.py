"""Jaccard self-join on word n-grams by vertical partitioning.

A text's set holds the hashes of its distinct five-word shingles (words are
runs without white space, A-Z lower-cased; fewer words make one shingle, no
words an empty set).  Two documents link when 100 * intersection >= 80 * union.

1. The hash order of n-grams is cut into fragments.  Every task sends its
   documents' n-grams to their fragments as packed blocks, where each n-gram
   gets its document frequency; one that occurs once cannot be shared and
   goes no further.
2. Back at the blocks' documents, n-grams are in global order (frequency,
   hash).  Documents that link share an n-gram among the first
   n - ceil(0.8 n) + 1 of each (prefix filter), so those are the buckets.
   N-grams that occur once count as part of the prefix.
3. Equal sets are one class from here on.  A pair also has to fit by size and
   by what is left of both sets from the shared n-gram on (positional
   filter; one of the two must then be "strong", with the n-gram in its first
   ninth) and by the sets' parity bitmaps (bitmap filter).  In each bucket every class is paired with one strong centre (linear
   in the rows), pairs are verified, and links gathered to components.
4. What is left in a bucket in different components is paired with all of the
   others there, and verified: no link between components is lost, while the
   pairs within a group of copies are never listed.

A pair is verified by counting its overlap in each of ``CUTS`` fragments of the
hash order separately and summing per pair.  Counts are exact but for equal
hashes: 64 bits from 16,384 fragments (four a shuffle partition) on, at least 50
bits and the fragment below that.

Defined results: null and empty texts have no shingle and link with nothing;
each input row gives one output row; rows that share a doc_id are one document
and link; a row without an id takes part under its text, and its component_id
is null where no id is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import materialize

from .memory import give_back
from .registry import load, register

WORDS = 5
SHARE = 80  # per cent
CUTS = 4
SLICE_BYTES = 1 << 18  # bytes of text hashed at once
BLOCK_GRAMS = 700_000  # n-grams of a block, and
BLOCK_DOCS = 16_000  # documents of a block (at most 1 << DOC_BITS)
PARITY_BITS = 1024  # of a set's parity bitmap, in 64-bit words
WORDS_64 = PARITY_BITS // 64
DOC_BITS = 14  # of a document's number in its block
LOW_BITS = 64 - DOC_BITS  # of a hash kept besides its fragment
MAX_FRAGMENTS = 1 << 22
HOT = 64  # documents of a block from which an n-gram is counted there

_SEED = 0x9E3779B97F4A7C15
_POWER = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_PLACES = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(_SEED + 2))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of a byte array that ends in
    white space."""
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.flatnonzero(~space)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    powers = np.ones(int(sizes.max()), np.uint64)
    if len(powers) > 1:
        powers[1:] = np.cumprod(np.full(len(powers) - 1, _POWER))
    return starts, _mix(np.add.reduceat(_BYTES[raw[at]] * powers[place], first))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raws = [(t or "").encode() + b"\n" for t in texts]
    begin = np.cumsum([0] + [len(r) for r in raws])
    starts, words = _word_hashes(np.frombuffer(b"".join(raws), np.uint8))
    first = np.searchsorted(starts, begin)
    grams = sum(
        (words[k:len(words) - WORDS + 1 + k] * _PLACES[k] for k in range(WORDS)),
        np.zeros(max(0, len(words) - WORDS + 1), np.uint64))
    grams = _mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(grams[a:b - WORDS + 1]))
        else:
            short = (words[a:b] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(short + np.uint64(_SEED + n)) if n else words[:0])
    return out


def _slices(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > SLICE_BYTES:
            yield shingle_sets(held)
            held, size = [], 0
    if held:
        yield shingle_sets(held)


def _starts(fragments: int) -> np.ndarray:
    """First hash of each fragment of the hash order."""
    p = np.arange(fragments, dtype=np.uint64) << np.uint64(24)
    return (p + np.uint64(fragments - 1)) // np.uint64(fragments) << np.uint64(40)


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    return (grams >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)


def _whole(start: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Hashes from the start of their fragment and their low bits: all 64 bits
    from 1 << DOC_BITS fragments on; with fewer, that is on less data, 50 bits
    and the fragment."""
    return start + ((low - start) & np.uint64((1 << LOW_BITS) - 1))


# A block's entry is low bits << DOC_BITS | document number, stored plane by
# plane, so that the sorted leading bytes compress in a shuffle.
def _pack(entries: np.ndarray) -> bytes:
    return entries.astype("<u8").view(np.uint8).reshape(-1, 8)[:, ::-1].T.tobytes()


def _unpack(block: bytes) -> np.ndarray:
    if not block:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(block, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes[::-1].T).view("<u8").ravel()


def _pairs(data: bytes | None) -> np.ndarray:
    """(hash, number) rows of hot n-grams."""
    return np.frombuffer(data, np.uint64).reshape(-1, 2) if data else np.zeros((0, 2), np.uint64)


def _levels(often: np.ndarray) -> np.ndarray:
    """Frequency levels, eight a doubling: the first part of the global order."""
    return np.minimum(255, 8 * np.log2(often)).astype(np.uint8)


def _parity(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bitmap of each set: whether an odd number of its n-grams falls into each
    of ``PARITY_BITS`` classes."""
    out = np.zeros((len(sizes), WORDS_64), np.uint64)
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), 512):
        part = sizes[at:at + 512]
        inside = grams[ends[at] - sizes[at]:ends[at + len(part) - 1]]
        doc = np.repeat(np.arange(len(part)), part)
        cell = doc * PARITY_BITS + ((inside >> np.uint64(8)) % np.uint64(PARITY_BITS)).astype(np.int64)
        odd = (np.bincount(cell, minlength=len(part) * PARITY_BITS) & 1).astype(bool)
        out[at:at + 512] = np.packbits(odd.reshape(-1, PARITY_BITS), axis=1).view(np.uint64)
    return out


_ROW = ("block bigint, fragment int, data binary, hot binary, held binary, ids binary, "
        "sizes binary, marks binary")
_ARROW_ROW = pa.schema([
    ("block", pa.int64()), ("fragment", pa.int32()), ("data", pa.binary()),
    ("hot", pa.binary()), ("held", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("marks", pa.binary()),
])


def _blocks(docs: DataFrame, id_col: str, text_col: str, fragments: int) -> DataFrame:
    """Packed n-grams by (block, fragment); and one row per block (without
    data) that names its documents: ids, set sizes, and 128-bit set marks with
    the parity bitmap.

    An n-gram of ``HOT`` or more of the block's documents goes to its fragment as
    one count, so that a fragment holds at most ``HOT`` entries of it a block
    however frequent it is; its documents stay in the block's own row (``held``).
    """
    starts = _starts(fragments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        count = 0
        sets: list[np.ndarray] = []
        ids: list[int | None] = []

        def flush():
            nonlocal count
            sizes = np.array([len(s) for s in sets], np.int64)
            grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            marks = np.zeros((len(sets), 2), np.uint64)
            some = np.flatnonzero(sizes)
            if len(some):
                at = (np.cumsum(sizes) - sizes)[some]
                marks[some, 0] = np.add.reduceat(_mix(grams + np.uint64(_SEED)), at)
                marks[some, 1] = np.add.reduceat(_mix(grams ^ np.uint64(_SEED)), at)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
            marks = np.column_stack([marks, _parity(grams, sizes)])
            part = _fragment(grams, fragments)
            grams = _whole(starts[part], grams)
            order = np.argsort(grams, kind="stable")
            grams, doc, part = grams[order], doc[order], part[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([grams[:1] == grams[:1], grams[1:] != grams[:-1]]))
            runs = np.diff(np.append(first, len(grams)))
            often = runs >= HOT
            hot = np.column_stack([grams[first[often]], runs[often].astype(np.uint64)])
            hot_part = part[first[often]]
            often = np.repeat(often, runs)
            held = doc[often].astype(np.uint16)
            entry = (grams[~often] & np.uint64((1 << LOW_BITS) - 1)) << np.uint64(DOC_BITS) | doc[~often]
            part = part[~often]
            block = base | count
            used = np.union1d(part, hot_part)
            ends = [np.append(np.searchsorted(p, used), len(p)).tolist() for p in (part, hot_part)]
            names = [
                (block, int(f), _pack(entry[a:b]), hot[c:d].tobytes() if d > c else None, None, None, None, None)
                for f, a, b, c, d in zip(used, ends[0], ends[0][1:], ends[1], ends[1][1:])]
            known = np.array([i is not None for i in ids], np.int64)
            number = np.array([i or 0 for i in ids], np.int64)
            names.append((block, block % fragments, None, hot.tobytes(), held.tobytes(),
                          np.stack([number, known], 1).tobytes(), sizes.tobytes(), marks.tobytes()))
            count += 1
            sets.clear()
            ids.clear()
            cols = list(zip(*names))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(cols, _ARROW_ROW)], schema=_ARROW_ROW)

        held = 0
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for group in _slices(batch.column(1).to_pylist()):
                for s in group:
                    sets.append(s)
                    ids.append(keys[at])
                    held += len(s)
                    at += 1
                    if held >= BLOCK_GRAMS or len(sets) >= BLOCK_DOCS:
                        yield flush()
                        held = 0
        if sets:
            yield flush()
        give_back()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _ROW)


def _count(blocks: DataFrame) -> DataFrame:
    """Per block and fragment, the entries whose n-gram occurs in more than
    one document, each followed by its frequency level (a byte), and the hot
    n-grams with their level in place of the block's count.  Rows that name
    documents pass through."""

    def run(table: pa.Table) -> pa.Table:
        named = table.filter(pa.compute.is_null(table["data"]))
        table = table.filter(pa.compute.is_valid(table["data"]))
        if not table.num_rows:
            return named
        parts = [_unpack(d.as_py()) for d in table["data"]]
        hots = [_pairs(h.as_py()) for h in table["hot"]]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        entry, hot = np.concatenate(parts), np.concatenate(hots)
        # Within a fragment, low bits name the n-gram.
        low = np.uint64((1 << LOW_BITS) - 1)
        order = np.argsort(entry >> np.uint64(DOC_BITS), kind="stable")
        entry, owner = entry[order], owner[order]
        gram = entry >> np.uint64(DOC_BITS)
        first = np.flatnonzero(np.concatenate([gram[:1] == gram[:1], gram[1:] != gram[:-1]]))
        runs = np.diff(np.append(first, len(gram)))
        # Counts of hot n-grams, summed over blocks, join those of entries.
        names, of = np.unique(hot[:, 0] & low, return_inverse=True)
        total = np.bincount(of, hot[:, 1].astype(np.int64), len(names)).astype(np.int64)
        if len(first) and len(names):
            at = np.minimum(np.searchsorted(gram[first], names), len(first) - 1)
            both = gram[first[at]] == names
            total[both] += runs[at[both]]
            runs_all = runs.copy()
            runs_all[at[both]] = total[both]
        else:
            runs_all = runs
        often = np.repeat(runs_all, runs)
        keep = often > 1
        entry, owner, often = entry[keep], owner[keep], often[keep]
        level = _levels(often)
        order = np.argsort(owner, kind="stable")
        entry, owner, level = entry[order], owner[order], level[order]
        bounds = np.searchsorted(owner, np.arange(len(parts) + 1)).tolist()
        data = [_pack(entry[a:b]) + level[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        hot = np.column_stack([hot[:, 0], _levels(total[of]).astype(np.uint64)])
        ends = np.cumsum([0] + [len(h) for h in hots]).tolist()
        back = [hot[a:b].tobytes() if b > a else None for a, b in zip(ends[:-1], ends[1:])]
        table = table.set_column(2, "data", pa.array(data, pa.binary()))
        table = table.set_column(3, "hot", pa.array(back, pa.binary()))
        some = [bool(d) or h is not None for d, h in zip(data, back)]
        return pa.concat_tables([named, table.filter(pa.array(some, pa.bool_()))])

    return blocks.groupBy("fragment").applyInArrow(run, _ROW)


_OUT = ("kind int, doc_id bigint, n bigint, mark1 bigint, mark2 bigint, gram bigint, "
        "rest bigint, bits array<bigint>, cut int, grams binary")
_ARROW_OUT = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("mark1", pa.int64()),
    ("mark2", pa.int64()), ("gram", pa.int64()), ("rest", pa.int64()),
    ("bits", pa.list_(pa.int64())), ("cut", pa.int32()), ("grams", pa.binary()),
])
DOC, BUCKET, CUT = 0, 1, 2


def _prefixes(counted: DataFrame, fragments: int) -> DataFrame:
    """Rows of three kinds: each document; the prefix n-grams of each set
    that may link; and that set's shared n-grams in ``CUTS`` fragments of the
    hash order."""
    starts = _starts(fragments)

    def run(table: pa.Table) -> pa.Table:
        is_name = pa.compute.is_null(table["data"])
        name = table.filter(is_name)
        ids, known = np.frombuffer(name["ids"][0].as_py(), np.int64).reshape(-1, 2).T
        n = np.frombuffer(name["sizes"][0].as_py(), np.int64)
        marks = np.frombuffer(name["marks"][0].as_py(), np.int64).reshape(-1, 2 + WORDS_64)
        marks, bits = marks[:, :2], marks[:, 2:]
        each = pa.ListArray.from_arrays(
            np.arange(0, len(n) * WORDS_64 + 1, WORDS_64, dtype=np.int32),
            np.ascontiguousarray(bits).ravel())
        out = [_rows(DOC, n, marks, doc_id=pa.array(ids, mask=known == 0), bits=each)]
        table = table.filter(pa.compute.invert(is_name))
        if table.num_rows:
            doc, level, gram, hots = [], [], [], []
            for part, data, hot in zip(table["fragment"].to_pylist(), table["data"], table["hot"]):
                data = data.as_py()
                k = len(data) // 9
                e = _unpack(data[:8 * k])
                doc.append(e & np.uint64((1 << DOC_BITS) - 1))
                gram.append(_whole(starts[part], e >> np.uint64(DOC_BITS)))
                level.append(np.frombuffer(data[8 * k:], np.uint8))
                hots.append(_pairs(hot.as_py()))
            # The block's own documents of hot n-grams, with the level found.
            own, found = _pairs(name["hot"][0].as_py()), np.concatenate(hots)
            times = own[:, 1].astype(np.int64)
            found = found[np.argsort(found[:, 0])]
            doc.append(np.frombuffer(name["held"][0].as_py(), np.uint16).astype(np.uint64))
            gram.append(np.repeat(own[:, 0], times))
            level.append(np.repeat(found[np.searchsorted(found[:, 0], own[:, 0]), 1].astype(np.uint8), times))
            doc = np.concatenate(doc).astype(np.int64)
            gram = np.concatenate(gram).view(np.int64)
            level = np.concatenate(level)
            shared = np.bincount(doc, minlength=len(n))
            # Prefix length, less the n-grams that occur once.
            room = n - (SHARE * n + 99) // 100 + 1 - (n - shared)
            _, lead = np.unique(marks, axis=0, return_index=True)
            want = np.zeros(len(n), bool)
            want[lead] = True  # one of equal sets is enough
            want &= (room > 0) & (n > 0)
            keep = want[doc]
            doc, gram, level = doc[keep], gram[keep], level[keep]
            order = np.lexsort((gram, level, doc))
            doc, gram = doc[order], gram[order]
            begin = np.searchsorted(doc, np.arange(len(n)))
            place = np.arange(len(doc)) - begin[doc]
            head = place < room[doc]
            # The set's n-grams from this one on, in global order.
            rest = shared[doc] - place
            out.append(_rows(BUCKET, n[doc[head]], marks[doc[head]], gram=gram[head], rest=rest[head]))
            cut = (gram.view(np.uint64) >> np.uint64(48)).astype(np.int64) * CUTS >> 16
            order = np.lexsort((gram, cut, doc))
            doc, gram, cut = doc[order], gram[order], cut[order]
            at = np.flatnonzero(np.diff(doc * CUTS + cut, prepend=-1))
            bounds = np.append(at, len(doc)).tolist()
            grams = [gram[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            out.append(_rows(CUT, n[doc[at]], marks[doc[at]], cut=cut[at].astype(np.int32),
                             grams=pa.array(grams, pa.binary())))
        give_back()
        return pa.concat_tables(out)

    return counted.groupBy("block").applyInArrow(run, _OUT)


def _rows(kind: int, n: np.ndarray, marks: np.ndarray, **columns) -> pa.Table:
    given = {"kind": np.full(len(n), kind, np.int32), "n": n,
             "mark1": np.ascontiguousarray(marks[:, 0]), "mark2": np.ascontiguousarray(marks[:, 1])}
    given |= columns
    return pa.Table.from_arrays(
        [(given[f.name] if isinstance(given[f.name], pa.Array) else pa.array(given[f.name], f.type))
         if f.name in given else pa.nulls(len(n), f.type)
         for f in _ARROW_OUT], schema=_ARROW_OUT)


def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([
        len(np.intersect1d(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64),
                           assume_unique=True))
        for x, y in zip(a, b)], pa.int64())


def _verified(pairs: DataFrame, cuts: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that link, as (a, b)."""
    left = cuts.select(F.col("node").alias("a"), "cut", F.col("grams").alias("ga"))
    right = cuts.select(F.col("node").alias("b"), "cut", F.col("grams").alias("gb"))
    overlap = F.arrow_udf(_overlap, "bigint")
    parts = pairs.join(left, "a").join(right, ["b", "cut"])
    o = F.col("o")
    return (
        parts.select("a", "b", "na", "nb", overlap("ga", "gb").alias("part"))
        .groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
        .filter(100 * o >= SHARE * (F.col("na") + F.col("nb") - o))
        .select("a", "b")
    )


_SEAT = ["node", "n", "rest", "bits"]


def _seat(prefix: str = "") -> list[Column]:
    """A bucket row's columns, renamed with a prefix."""
    return [F.col(c).alias(prefix + c) for c in _SEAT]


def _fits(x: str, y: str) -> Column:
    """Whether rows with prefixes ``x`` and ``y`` of one bucket can link: by
    what is left of each from the bucket's n-gram on (positional filter), and
    because each bit in which the parity bitmaps differ stands for at least one
    n-gram that only one of the sets has (bitmap filter)."""
    both = F.col(f"{x}n") + F.col(f"{y}n")
    apart = sum(F.bit_count(F.col(f"{x}bits")[k].bitwiseXOR(F.col(f"{y}bits")[k]))
                for k in range(WORDS_64))
    return (((100 + SHARE) * F.least(f"{x}rest", f"{y}rest") >= SHARE * both)
            & ((100 + SHARE) * (both - apart) >= 2 * SHARE * both))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, na, nb) with a < b of rows with prefixes x_, y_."""
    first = F.col("x_node") < F.col("y_node")
    return pairs.select(
        F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"),
        F.when(first, F.col("x_n")).otherwise(F.col("y_n")).alias("na"),
        F.when(first, F.col("y_n")).otherwise(F.col("x_n")).alias("nb")).distinct()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of each connected component of edges
    (a, b).  Labels pass along edges and then jump to their label's label, so
    rounds follow the logarithm of a component's width; each is written to the
    shared folder."""
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(), f"{name}-edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("root")), name)
    while True:
        heard = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m")))
        told = labels.join(heard, labels.node == heard.a, "left").select(
            "node", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = materialize(
            told.join(far, "root", "left").select(
                "node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), name)
        labels = after.select("node", "root")
        if after.filter("root < was").isEmpty():
            return labels


def link_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    fragments = min(MAX_FRAGMENTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = _blocks(docs, id_col, text_col, fragments)
    found = materialize(_prefixes(_count(blocks), fragments), "ngram-rows")

    # Classes of equal sets; a written table keeps their numbers fixed.
    rows = found.filter(F.col("kind") == DOC).select("doc_id", "n", "mark1", "mark2", "bits")
    nodes = materialize(
        rows.groupBy("mark1", "mark2").agg(
            F.max("n").alias("n"), F.min("doc_id").alias("first"), F.any_value("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    rows = rows.drop("bits")
    bits = nodes.select("node", "bits")
    number = nodes.select("mark1", "mark2", "node")
    marks = ["mark1", "mark2"]
    seats = (
        found.filter(F.col("kind") == BUCKET).select("gram", "n", "rest", *marks)
        .dropDuplicates(["gram", *marks]).join(number, marks)
        .select("gram", "node", "n", "rest",
                ((100 + SHARE) * F.col("rest") >= 2 * SHARE * F.col("n")).alias("strong")))
    centre = F.min_by(F.struct("node", "n", "rest"), F.when(F.col("strong"), F.xxhash64("gram", "node")))
    full = seats.groupBy("gram").agg(
        F.count("*").alias("k"), F.bool_or("strong").alias("any_strong"), centre.alias("c"),
    ).filter("k > 1 and any_strong").select("gram", "c")
    seats = seats.join(full, "gram").join(bits, "node").select(
        "gram", *_SEAT, "strong", *[F.col(f"c.{c}").alias(f"y_{c}") for c in ("node", "n", "rest")])
    far = bits.select(F.col("node").alias("y_node"), F.col("bits").alias("y_bits"))
    seats = materialize(seats.join(far, "y_node"), "ngram-buckets")
    cuts = materialize(
        found.filter(F.col("kind") == CUT).select("cut", "grams", *marks)
        .join(number, marks).join(seats.select("node").distinct(), "node", "left_semi")
        .dropDuplicates(["node", "cut"]).select("node", "cut", "grams"), "ngram-cuts")

    starred = seats.select("gram", *_seat("x_"), *[f"y_{c}" for c in _SEAT])
    stars = materialize(_ordered(
        starred.filter((F.col("x_node") != F.col("y_node")) & _fits("x_", "y_"))), "ngram-stars")
    links = materialize(_verified(stars, cuts), "ngram-links")
    parts = connected(links, "ngram-parts")

    # Buckets that still hold several components: everything outside a
    # bucket's largest component meets the classes of other components there.
    # A strong class takes part in every pair that fits.
    seats = seats.select("gram", *_SEAT, "strong").join(parts, "node", "left").select(
        "gram", *_SEAT, "strong", F.coalesce("root", "node").alias("part"))
    sizes = seats.groupBy("gram", "part").agg(F.count("*").alias("k"))
    torn = sizes.groupBy("gram").agg(
        F.count("*").alias("parts"), F.max_by("part", F.struct("k", "part")).alias("main")
    ).filter("parts > 1").select("gram", "main")
    open_seats = materialize(seats.join(torn, "gram"), "ngram-open")
    # Linked sets differ by at most a quarter in size: a band or the next one.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / SHARE))).cast("int")
    near = F.explode(F.array(band - 1, band, band + 1)).alias("band")
    x = open_seats.filter(F.col("part") != F.col("main")).select(
        "gram", near, *_seat("x_"), F.col("part").alias("px"), F.col("strong").alias("sx"))
    y = open_seats.select(
        "gram", band.alias("band"), *_seat("y_"), F.col("part").alias("py"), F.col("strong").alias("sy"))
    fits = (F.col("px") != F.col("py")) & _fits("x_", "y_")
    rest = materialize(_ordered(
        x.filter("sx").join(y, ["gram", "band"]).filter(fits)
        .unionByName(x.filter("not sx").join(y.filter("sy"), ["gram", "band"]).filter(fits))
    ).join(stars.select("a", "b"), ["a", "b"], "left_anti"), "ngram-rest")
    # Sets without shingles link with nothing, so they pass no link on either.
    named = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).join(number, marks).select("doc_id", "node")
    span = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    same = named.join(span.filter("a < z"), "doc_id").filter("node > a").select(
        "a", F.col("node").alias("b"))
    more = materialize(_verified(rest, cuts).unionByName(same), "ngram-more")
    roots = parts
    if not more.isEmpty():
        roots = connected(links.unionByName(more), "ngram-roots")

    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named_classes = grouped.join(label, "root").select(*marks, "component_id")
    # Sets without shingles link with nothing.
    return rows.join(named_classes, marks, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each linked group: the one with the
    smallest id.  Of rows that share an id, the first by text stays; rows
    without an id cannot be named by a group and stay."""
    linked = link_documents(docs, id_col, text_col)
    keep = linked.filter("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last()))
    named = (
        docs.join(keep, docs[id_col] == F.col("_keep"), "left_semi")
        .withColumn("_row", first).filter("_row = 1").drop("_row"))
    return named.unionByName(docs.filter(F.col(id_col).isNull()))


@register("op8_ngram_jaccard")
def op8_ngram_jaccard(spark, sf_dir):
    return link_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))
