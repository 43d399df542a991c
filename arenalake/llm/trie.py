"""Conversation prefix trie by adaptive radix trees over fixed-width big-endian turn ids.

A turn is an id of 16 bytes: the length of its text in bytes (big-endian, so a node's own size can be read from its path)
and 96 bits of a SHA-256 of role and text.  A conversation is the concatenation of its turns' ids, its key.  Distinct
keys are range-partitioned in order; each part builds an adaptive radix tree (nodes of 4, 16, 48 and 256 children, paths
compressed) and emits what it holds of every prefix, but only at byte depths that end a turn.  Prefixes on the edge of two
parts are emitted by both and summed; so that distinct nodes, children and leaves count once, a part is told the last key
before it and the first after it.  Equal keys are counted before they are sorted, so a much-copied conversation is one
key, and the ids that end at a node travel as packed runs in order, from which its digest is streamed.

Each row is a turn.  Turns are ordered by turn (null first), ties by id; a null role or text is empty; repeated rows are
turns of their own; rows with a null conv_id belong to no conversation and are left out; an empty table has no nodes.
Extra columns are ignored.  A task holds the ids (not the texts) of one conversation at a time, or of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 16  #: bytes of a turn id
PART_BYTES = 16 << 20  #: keys of a part, about
RUN = 1 << 16  #: conversation ids in a packed run, at most


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.lower(F.lpad(F.hex(F.octet_length(text)), 8, "0")), F.substring(told, 1, WIDTH * 2 - 8))


def keys(turns: DataFrame, group: Column | None = None) -> DataFrame:
    """group, conv_id, key of every conversation; those of a group come together."""
    rows = turns.filter("conv_id is not null")
    rows = rows.select((F.col("conv_id") if group is None else group).alias("group"), "conv_id", "turn", turn_id(F.col("role"), F.col("text")).alias("id"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"])
    return rows.repartition("group").groupBy("group", "conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("key"))


def spliced(turns: DataFrame) -> DataFrame:
    """conv_id, key of every conversation c with its first h turns replaced by those of c - c % 5; h is crc32(c) % 9."""
    own = keys(turns, F.col("conv_id") - F.col("conv_id") % 5)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9 * WIDTH).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("group"), F.col("key"))).over(Window.partitionBy("group"))  # nine at most in a group
    head = F.substring(F.coalesce(first, F.lit(b"")), F.lit(1), h)
    return own.select("conv_id", F.concat(head, F.substring("key", h + 1, F.length("key"))).alias("key"))


# --- the tree -----------------------------------------------------------------------------------------------------------


class _Sorted:
    """Up to 4 or 16 children: their bytes, and the children beside them."""

    __slots__ = ("bytes", "children", "room")

    def __init__(self, room: int) -> None:
        self.bytes, self.children, self.room = bytearray(), [], room

    def get(self, byte: int):
        i = self.bytes.find(byte)
        return self.children[i] if i >= 0 else None

    def put(self, byte: int, child):
        if len(self.bytes) == self.room:
            wider = _Sorted(16) if self.room == 4 else _Indexed()
            for b, c in zip(self.bytes, self.children, strict=True):
                wider.put(b, c)
            return wider.put(byte, child)
        self.bytes.append(byte)
        self.children.append(child)
        return self


class _Indexed:
    """Up to 48 children, found by an index of 256 bytes."""

    __slots__ = ("children", "index")

    def __init__(self) -> None:
        self.index, self.children = bytearray(256), []

    def get(self, byte: int):
        i = self.index[byte]
        return self.children[i - 1] if i else None

    def put(self, byte: int, child):
        if len(self.children) == 48:
            wider = _Full()
            for b, i in enumerate(self.index):
                if i:
                    wider.put(b, self.children[i - 1])
            return wider.put(byte, child)
        self.children.append(child)
        self.index[byte] = len(self.children)
        return self


class _Full:
    """A place for each byte."""

    __slots__ = ("places",)

    def __init__(self) -> None:
        self.places = [None] * 256

    def get(self, byte: int):
        return self.places[byte]

    def put(self, byte: int, child):
        self.places[byte] = child
        return self

    @property
    def children(self) -> list:
        return [c for c in self.places if c is not None]


class _Node:
    """``path``: the bytes between the parent's branch and this node's; ``at``: a key that passes, by number; ``ends``: the
    number of the key that ends here, or -1."""

    __slots__ = ("at", "branches", "ends", "path")

    def __init__(self, path: bytes, at: int, ends: int) -> None:
        self.path, self.at, self.ends, self.branches = path, at, ends, None

    def branch(self, byte: int, child: _Node) -> None:
        self.branches = (self.branches or _Sorted(4)).put(byte, child)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _tree(keys: list[bytes]) -> _Node:
    root = _Node(keys[0], 0, 0)
    for i in range(1, len(keys)):
        key, node, at = keys[i], root, 0
        while True:
            path = node.path
            n = _common(path, key[at : at + len(path)])
            if n < len(path):  # the path forks: what hung here hangs below
                lower = _Node(path[n + 1 :], node.at, node.ends)
                lower.branches, node.branches = node.branches, None
                node.path, node.ends = path[:n], -1
                node.branch(path[n], lower)
            at += n
            if at == len(key):
                node.ends = i
                break
            child = node.branches.get(key[at]) if node.branches else None
            if child is None:
                node.branch(key[at], _Node(key[at + 1 :], i, i))
                break
            node, at = child, at + 1
    return root


PARTIAL = "id binary, parent binary, depth long, n long, conv long, children long, leaves long, held long, own long"


def _emit(keys: list[bytes], n: list[int], conv: list[int], before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """What a part's sorted, distinct keys add to each prefix of theirs, in turns.

    ``held``: bytes of the members' turns from the prefix' last on; ``own``: bytes of the nodes below, itself included, that
    no earlier part has.
    """
    shared = _common(before, keys[0]) // WIDTH if before is not None else -1  # depths on the first key's way that an earlier part has
    extended = after is not None and after.startswith(keys[-1])
    order: list[tuple[_Node, int, int, int, list[bytes]]] = []  # node, place of its parent, byte depth before and at it, prefix ids
    stack = [(_tree(keys), -1, -1, 0, hashlib.sha256())]
    while stack:
        node, up, above, begun, state = stack.pop()
        deep, ids, key = begun + len(node.path), [], keys[node.at]
        for d in range(above // WIDTH + 1, deep // WIDTH + 1):
            if d:
                state = state.copy()
                state.update(key[(d - 1) * WIDTH : d * WIDTH])
            ids.append(state.digest()[:WIDTH])
        last = order[up][4][-1] if up >= 0 else None
        order.append((node, up, above, deep, ids if ids else [last]))
        if node.branches is not None:
            stack += [(child, len(order) - 1, deep, deep + 1, state) for child in node.branches.children]
    size = len(order)
    total, least, first, leaves, held, own, open_ = [0] * size, [None] * size, [False] * size, [0] * size, [0] * size, [0] * size, [0] * size
    rows: list[tuple] = []
    for i in range(size - 1, -1, -1):  # children come after their parents
        node, up, above, deep, ids = order[i]
        if node.ends >= 0:
            total[i] += n[node.ends]
            least[i] = conv[node.ends] if least[i] is None else min(least[i], conv[node.ends])
            first[i] |= node.ends == 0
            leaves[i] += node.branches is None and not (node.ends == len(keys) - 1 and extended)
        key, children = keys[node.at], open_[i]
        lowest = above // WIDTH + 1
        for d in range(deep // WIDTH, lowest - 1, -1):
            mine = not (first[i] and d <= shared)
            width = int.from_bytes(key[(d - 1) * WIDTH : (d - 1) * WIDTH + 4], "big") if d else 0
            held[i] += total[i] * width
            own[i] += width if mine else 0
            parent = (ids[d - lowest - 1] if d > lowest else order[up][4][-1]) if d else None
            rows.append((ids[d - lowest], parent, d, total[i], least[i], children, leaves[i], held[i], own[i]))
            children = int(mine)
        if up >= 0:
            total[up] += total[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            first[up] |= first[i]
            leaves[up] += leaves[i]
            held[up] += held[i]
            own[up] += own[i]
            open_[up] += children  # of the next depth: its top row, or what hangs below where it has none
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.binary()] * 2 + [pa.int64()] * 7, strict=True)], names=[x.split()[0] for x in PARTIAL.split(", ")])


def _part(rows: pa.Table, edges: pa.Table) -> pa.Table:
    rows = rows.sort_by("key")
    before, after = (edges.column(c)[0].as_py() for c in ("before", "after"))
    return pa.Table.from_batches([_emit(*(rows.column(c).to_pylist() for c in ("key", "n", "conv")), before, after)])


# --- digests ------------------------------------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the ids of a node, of sorted rows (id, conv): node, first conversation, the decimals joined."""
    node, run = None, []

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["id", "first", "ids"])

    for batch in batches:
        found = []
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i != node or len(run) == RUN:
                if run:
                    found.append((node, run[0], ",".join(map(str, run))))
                node, run = i, []
            run.append(c)
        if found:
            yield rows(found)
    if run:
        yield rows([(node, run[0], ",".join(map(str, run)))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node, of its runs in order."""
    node, state = None, None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], names=["id", "ends_sha256"])

    for batch in batches:
        found = []
        for i, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if i != node:
                if node is not None:
                    found.append((node, state.hexdigest()))
                node, state = i, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if found:
            yield rows(found)
    if node is not None:
        yield rows([(node, state.hexdigest())])


def ends(keyed: DataFrame, parts: int) -> DataFrame:
    """id, ends_sha256 of the nodes at which conversations end.

    A digest is one chain over its ids, so a node's runs meet in one task, which holds a run (of 65,536 ids) at a time.
    """
    rows = keyed.select(F.expr(f"substring(unhex(sha2(key, 256)), 1, {WIDTH})").alias("id"), "conv_id")
    packed = rows.repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_packed, "id binary, first long, ids string")
    return packed.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id binary, ends_sha256 string")


def nodes(keyed: DataFrame) -> DataFrame:
    """id, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the
    trie over ``keyed`` (conv_id, key)."""
    keyed = materialize(keyed.select("conv_id", "key"), "conversations")
    bytes_ = keyed.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    parts = max(1, -(-bytes_ // PART_BYTES))
    distinct = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    dealt = distinct.repartitionByRange(parts, "key").select("*", F.spark_partition_id().alias("part"))
    dealt = materialize(dealt, "keys")
    every = Window.orderBy("part")  # a row a part
    edges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = edges.select("part", F.lag("high").over(every).alias("before"), F.lead("low").over(every).alias("after"))
    partial = dealt.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_part, PARTIAL)
    whole = partial.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), (F.sum("held") - F.sum("own")).alias("saved_tokens"),
    )
    whole = materialize(whole.join(ends(keyed, parts), "id", "left"), "nodes")
    parents = whole.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(parents, "parent", "left")
    return out.select("id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS b, length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS told
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, b, lower(printf('%08x', b)) || sha256(told)[1:24] AS id FROM t),
c AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids FROM i GROUP BY conv_id),
h AS (SELECT conv_id, ids, conv_id - conv_id % 5 AS base,
             xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ord((conv_id::VARCHAR)[k])::BIGINT),
                             lambda a, x: list_reduce([1::BIGINT, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(a, x)), 4294967295::BIGINT), 4294967295) % 9 AS h
      FROM c),
s AS (SELECT h.conv_id, coalesce(c.ids[1:h.h], []) || h.ids[h.h + 1:] AS ids FROM h LEFT JOIN c ON c.conv_id = h.base),
p AS (SELECT conv_id, len(ids) AS n, d, array_to_string(ids[1:d], '') AS path FROM (SELECT conv_id, ids, unnest(range(0, len(ids) + 1)) AS d FROM s)),
n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n) AS ends FROM p GROUP BY path),
k AS (SELECT path[:len(path) - 32] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * ('0x' || path[len(path) - 31:len(path) - 24])::BIGINT ELSE 0 END AS saved FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[:32 * a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u USING (path) LEFT JOIN n q ON m.depth > 0 AND q.path = m.path[:len(m.path) - 32]
"""
