"""Prefix trie of conversations: adaptive radix trees over ranges of them.

A turn's id has ``WIDTH`` bytes: the first bytes of the SHA-256 of its role and
text, then the text's code points as a big-endian number.  A conversation is
the string of its turns' ids, and a trie node is a string of whole ids that
some conversation starts with.

* Conversations are dealt by ranges of (id string, conversation), so a much
  repeated one is spread over tasks.  Each task folds equal neighbours into a
  row with their number, smallest conversation and joined conversation numbers.
* Those rows are dealt by ranges of the id string, sorted, and taken in blocks
  of at most ``BLOCK_BYTES``.  A block is loaded into an adaptive radix tree:
  inner nodes hold up to 4, 16, 48 or 256 children and change their layout as
  they grow, and bytes without a branch are kept as a node's compressed path.
  Only byte depths that are multiples of ``WIDTH`` are trie nodes.
* A trie node that neither the block's first nor its last string passes
  through has all its members in the block and is finished there.  The others
  (two paths a block) are summed over blocks: members, children and leaves add
  up, and the code points of a node that several blocks hold are taken off once,
  by the first block's path, as a running sum up that path.

The digest of a node's ends runs over all of them in order; that one value is
computed as a stream in one task, from already joined pieces.

Defined results: rows of null ``conv_id`` belong to no conversation; null role
or text is empty; null turns come first and rows of one turn follow in order of
their ids; without conversations there is no node; other columns are ignored.
Ids carry 96 bits of the digest: equal ids are taken as equal turns.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .registry import load, register

WIDTH = 16  # bytes of a turn id: 12 of its digest, 4 of its text's length
BLOCK_BYTES = 4 << 20
PIECE_CHARS = 1 << 20  # joined conversation numbers of one row
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- adaptive radix tree -------------------------------------------------------------

class Sorted:
    """Up to 16 children in order of their bytes (layouts of 4 and of 16)."""

    def __init__(self, room: int = 4):
        self.room, self.keys, self.kids = room, bytearray(), []

    def get(self, byte: int):
        i = bisect_left(self.keys, byte)
        return self.kids[i] if i < len(self.keys) and self.keys[i] == byte else None

    def put(self, byte: int, kid):
        """The layout with one more child: this one, or a larger one."""
        if len(self.keys) == self.room:
            grown = Sorted(16) if self.room == 4 else Indexed()
            for k, old in zip(self.keys, self.kids):
                grown.put(k, old)
            return grown.put(byte, kid)
        i = bisect_left(self.keys, byte)
        self.keys.insert(i, byte)
        self.kids.insert(i, kid)
        return self

    def children(self) -> list:
        return self.kids


class Indexed:
    """Up to 48 children, found through a table of 256 places."""

    room = 48

    def __init__(self):
        self.place, self.kids = bytearray(256), []

    def get(self, byte: int):
        i = self.place[byte]
        return self.kids[i - 1] if i else None

    def put(self, byte: int, kid):
        if len(self.kids) == self.room:
            grown = Full()
            for k, i in enumerate(self.place):
                if i:
                    grown.put(k, self.kids[i - 1])
            return grown.put(byte, kid)
        self.kids.append(kid)
        self.place[byte] = len(self.kids)
        return self

    def children(self) -> list:
        return [self.kids[i - 1] for i in self.place if i]


class Full:
    """One place for each of 256 bytes."""

    room = 256

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def children(self) -> list:
        return [k for k in self.kids if k is not None]


class Node:
    """``path``: compressed bytes after the byte that leads here."""

    __slots__ = ("path", "kids", "value", "end", "edge", "n", "first", "key", "tops", "leaves", "saved", "spine")

    def __init__(self, path: bytes, value=None):
        self.path, self.kids, self.value, self.spine = path, None, value, False


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two byte strings."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixTree:
    def __init__(self):
        self.root = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at = self.root, 0
        while True:
            path = node.path
            if key[at:at + len(path)] != path:
                cut = _common(path, key[at:at + len(path)])
                lower = Node(path[cut + 1:], node.value)
                lower.kids = node.kids
                node.path, node.value, node.kids = path[:cut], None, Sorted().put(path[cut], lower)
            at += len(node.path)
            if at == len(key):
                node.value = value
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                node.kids = (node.kids or Sorted()).put(key[at], Node(key[at + 1:], value))
                return
            node, at = kid, at + 1

    def along(self, key: bytes) -> list[Node]:
        """The nodes from the root to a stored key."""
        node, at, out = self.root, 0, []
        while True:
            out.append(node)
            at += len(node.path)
            if at == len(key):
                return out
            node, at = node.kids.get(key[at]), at + 1

    def downwards(self) -> list[Node]:
        """All nodes, parents before children; sets where their edges lie."""
        self.root.end, self.root.edge = len(self.root.path), -1
        out = [self.root]
        for node in out:
            if node.kids:
                for kid in node.kids.children():
                    kid.edge, kid.end = node.end, node.end + 1 + len(kid.path)
                    out.append(kid)
        return out


# --- trie nodes of one block ------------------------------------------------------------

def _aligned(node: Node) -> range:
    """Turn-aligned depths (in turns) that the edge to a node passes."""
    return range(node.edge // WIDTH + 1, node.end // WIDTH + 1)


def _chars(key: bytes, depth: int) -> int:
    return int.from_bytes(key[depth * WIDTH - 4:depth * WIDTH], "big") if depth else 0


def _measure(nodes: list[Node]) -> None:
    """Members, smallest conversation, topmost trie nodes below, leaves and
    saved code points.  For nodes of the block's outer paths only what lies
    inside the block counts: ``tops`` and ``leaves`` leave out nodes of those
    paths, and ``saved`` takes their members without taking one off."""
    for node in reversed(nodes):
        kids = node.kids.children() if node.kids else []
        n, first, key = node.value[:3] if node.value else (0, None, None)
        tops = leaves = saved = 0
        for kid in kids:
            n += kid.n
            first = kid.first if first is None else min(first, kid.first)
            key = kid.key
            if _aligned(kid):
                tops += not kid.spine
            else:
                tops += kid.tops
            leaves += kid.leaves
            saved += kid.saved
        if not kids and not node.spine:
            leaves = 1
        members = n if node.spine else n - 1
        saved += sum(members * _chars(key, d) for d in _aligned(node))
        node.n, node.first, node.key, node.tops, node.leaves, node.saved = n, first, key, tops, leaves, saved


_COLUMNS = [
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("parent", pa.binary()), ("node", pa.binary()), ("chars", pa.int64()),
    ("block", pa.string()), ("chain", pa.int32())]
_ROWS = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, parent binary, node binary, chars long, block string, chain int")


def _digests(key: bytes) -> list[bytes]:
    """Digest of every prefix of whole turns."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for at in range(0, len(key), WIDTH):
        h.update(key[at:at + WIDTH])
        out.append(h.digest())
    return out


def block_nodes(sequences: list[tuple[bytes, int, int, str]], block: str) -> list[tuple]:
    """Rows (see ``_COLUMNS``) of a block of sorted, distinct id strings with
    their number, smallest conversation and digest of conversations.

    Finished nodes have no ``node``; if their parent is on an outer path, its
    digest is their ``parent``.  Nodes of outer paths come once for each path."""
    tree = RadixTree()
    for key, n, first, ends in sequences:
        tree.insert(key, (n, first, key, ends))
    nodes = tree.downwards()
    outer = [sequences[0][0], sequences[-1][0]]
    paths = [tree.along(key) for key in outer]
    digests = [_digests(key) for key in outer]
    names: dict[int, bytes] = {}  # id of an outer node -> digest of the deepest trie node at or above its end
    for path, digest in zip(paths, digests):
        for node in path:
            node.spine = True
            names[id(node)] = digest[node.end // WIDTH]
    _measure(nodes)
    out = []
    for chain, (key, path, digest) in enumerate(zip(outer, paths, digests)):
        if chain and key == outer[0]:
            break
        for node in path:
            # What both paths share is counted with the first.
            mine = chain == 0 or node not in paths[0]
            saved = node.saved
            for d in _aligned(node):
                last = (d + 1) * WIDTH > node.end
                ends = node.value[3] if node.value and d * WIDTH == node.end else None
                out.append((
                    node.first if mine else None, d, None, node.n if mine else 0,
                    node.tops if mine and last else 0, node.leaves if mine else 0, saved if mine else 0,
                    ends if mine else None, digest[d - 1] if d else None, digest[d], _chars(key, d), block, chain))
                saved -= node.n * _chars(key, d)
    above: dict[int, int | bytes] = {}  # id of a node -> its deepest trie node's conversation or digest
    for node in nodes:
        if node.spine:
            above[id(node)] = names[id(node)]
        kids = node.kids.children() if node.kids else ()
        for kid in kids:
            if kid.spine:
                continue
            parent, saved = above[id(node)], kid.saved
            for d in _aligned(kid):
                last = (d + 1) * WIDTH > kid.end
                ends = kid.value[3] if kid.value and d * WIDTH == kid.end else NO_ENDS
                known = isinstance(parent, int)
                out.append((
                    kid.first, d, parent if known else None, kid.n, kid.tops if last else 1, kid.leaves, saved,
                    ends, None if known else parent, None, None, None, None))
                saved -= (kid.n - 1) * _chars(kid.key, d)
                parent = kid.first
            above[id(kid)] = parent
    return out


# --- Spark ------------------------------------------------------------------------------

def turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, id): rows with the hexadecimal id of their turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    length = F.lower(F.lpad(F.hex(F.length(text).cast("long")), 8, "0"))
    return rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(F.substring(digest, 1, 2 * (WIDTH - 4)), length).alias("id"))


def id_strings(turns: DataFrame, group: str) -> DataFrame:
    """(group, conv_id, key): each conversation's turn ids in order, dealt by
    the column ``group``, of which ``conv_id`` is a refinement."""
    return (
        turns.repartition(group).groupBy(group, "conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "id"))).alias("t"))
        .select(group, "conv_id", F.unhex(F.array_join("t.id", "")).alias("key")))


def _fold(batches):
    """Equal neighbours of sorted (key, conv_id) rows as one row."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    key, first, n, ids, size = None, None, 0, [], 0
    for batch in batches:
        out = []
        for k, c in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
            if k != key or size > PIECE_CHARS:
                if n:
                    out.append((key, first, n, ",".join(ids)))
                key, first, n, ids, size = k, c, 0, [], 0
            n += 1
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield _batch(out, schema)
    if n:
        yield _batch([(key, first, n, ",".join(ids))], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _trees(batches):
    """Trie nodes of sorted (key, first, n, ids) rows."""
    from pyspark import TaskContext

    schema = pa.schema(_COLUMNS)
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    key, first, n, ends = None, None, 0, None

    def finished():
        return key, n, first, ends.hexdigest()

    for batch in batches:
        for k, f, m, ids in zip(*(batch[c].to_pylist() for c in ("key", "first", "n", "ids"))):
            if k == key:
                ends.update(b"," + ids.encode())
                n += m
                continue
            if n:
                held.append(finished())
                size += len(key) + 64
                if size > BLOCK_BYTES:
                    yield _batch(block_nodes(held, f"{task}-{number}"), schema)
                    held, size, number = [], 0, number + 1
            key, first, n, ends = k, f, m, hashlib.sha256(ids.encode())
    if n:
        held.append(finished())
        yield _batch(block_nodes(held, f"{task}-{number}"), schema)


def _merged_outer(rows: DataFrame) -> DataFrame:
    """Nodes of outer paths, summed over the blocks that hold them."""
    nodes = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("ends_sha256").alias("ends_sha256"), F.min(F.struct("block", "chain")).alias("owner"))
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("outer"))
    nodes = nodes.join(kids, "node", "left").withColumn(
        "n_children", F.col("inner") + F.coalesce("outer", F.lit(0))).drop("inner", "outer")
    # A node's own code points and its being a leaf count once, on the path
    # of its first block, and for every node above it on that path.
    owned = rows.select("node", "block", "chain", "depth", "chars").join(
        nodes.select("node", "owner", (F.col("n_children") == 0).cast("long").alias("leaf")), "node")
    mine = F.struct("block", "chain") == F.col("owner")
    upwards = Window.partitionBy("block", "chain").orderBy(F.col("depth").desc())
    once = owned.select(
        "node",
        F.sum(F.when(mine, F.col("chars")).otherwise(0)).over(upwards).alias("once"),
        F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(upwards).alias("more"))
    once = once.groupBy("node").agg(F.sum("once").alias("once"), F.sum("more").alias("more"))
    return nodes.join(once, "node").select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("more")).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(strings: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, key) rows, one conversation a row."""
    folded = (
        strings.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        .mapInArrow(_fold, "key binary, first long, n long, ids string"))
    rows = materialize(
        folded.repartitionByRange("key").sortWithinPartitions("key", "first").mapInArrow(_trees, _ROWS),
        "trie-nodes")
    outer = materialize(_merged_outer(rows.where(F.col("node").isNotNull())), "trie-outer")
    names = outer.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv"))
    done = rows.where(F.col("node").isNull())
    inside = done.where(F.col("parent").isNull()).select(*OUT)
    below = done.where(F.col("parent").isNotNull()).join(names, "parent")
    top = outer.join(names, "parent", "left")
    pick = [F.col("_parent_conv").alias(c) if c == "parent_conv_id" else F.col(c) for c in OUT]
    return inside.unionByName(below.select(*pick)).unionByName(top.select(*pick))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, key): conversation c as the first h turns of c - c % 100 and
    its own turns after its first h, h = crc32(c) % 6."""
    base = F.col("conv_id") - F.col("conv_id") % 100
    own = id_strings(turn_rows(rows).withColumn("base", base), "base")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("key", 1, 5 * WIDTH))).over(
        Window.partitionBy("base"))
    cut = (F.crc32(F.col("conv_id").cast("string")) % 6 * WIDTH).cast("int")
    empty = F.lit(b"")
    return own.withColumn("_head", head).withColumn("_cut", cut).select("conv_id", F.concat(
        F.coalesce(F.substring(F.col("_head"), F.lit(1), F.col("_cut")), empty),
        F.substring(F.col("key"), F.col("_cut") + 1, F.octet_length("key"))).alias("key"))


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           coalesce(text, '')) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
          string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END),
      4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
  SELECT heads.conv_id, 0 AS part, pos, said FROM heads JOIN t ON t.conv_id = base WHERE pos <= h
  UNION ALL SELECT conv_id, 1, pos, said FROM heads JOIN t USING (conv_id) WHERE pos > h),
seqs AS (
  SELECT conv_id, coalesce(list(said ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS s
  FROM heads LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
starts AS (
  SELECT conv_id, len(s) AS n, unnest(range(len(s) + 1)) AS depth, s FROM seqs),
nodes AS (
  SELECT depth, s[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM starts GROUP BY ALL),
kids AS (
  SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
one AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(k[depth].text) END AS own
  FROM nodes LEFT JOIN kids USING (depth, k)),
ups AS (
  SELECT d AS depth, k[1:d] AS k, n_children, own
  FROM (SELECT k, n_children, own, unnest(range(depth + 1)) AS d FROM one)),
sums AS (
  SELECT depth, k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM ups GROUP BY ALL)
SELECT one.conv_id, CAST(one.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, one.n_convs,
  CAST(one.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, one.ends_sha256
FROM one JOIN sums ON sums.depth = one.depth AND sums.k = one.k
LEFT JOIN nodes p ON p.depth = one.depth - 1 AND p.k = one.k[1:one.depth - 1]
"""


@register("op13_prefix_trie", SQL)
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
