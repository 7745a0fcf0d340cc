"""Prefix trie of conversations, built from adaptive radix trees.

A turn becomes a fixed-width big-endian id (the first WIDTH bytes of a SHA-256 of role
and text), a conversation the chain of its ids. Chains are cut into segments of SEGMENT
turns, so a conversation of any length is many short rows; a segment begins at the node
where the one before it ends, named by a 128-bit fingerprint of all ids up to there.
Segments are dealt by range of (start, ids, conversation), which puts common prefixes
side by side and still splits the members of one hot prefix over tasks. Every task
inserts its segments into an adaptive radix tree that sums what its members bring, and
emits the nodes at turn-aligned byte depths; a last grouping adds up the few nodes that
several tasks saw.

Sums over subtrees need no walk over the levels. The smallest member of a node is also
the smallest of one unbroken run of nodes down to its own end, so every node belongs to
one conversation's run, and a conversation adds the characters of its run, and its leaf,
to each node on its way."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baitwatch.llm.common import stage
from baitwatch.llm.turns import numbered

WIDTH = 16
SEGMENT = 256
# A tree is emitted and begun anew when it has taken in this many turns.
TREE_TURNS = 200_000
# Conversation ids of one list that are joined to text at once.
IDS = 4096


class Layout4:
    """Up to ``room`` children, by sorted key bytes; Layout16 is the same with more room."""

    room = 4

    def __init__(self) -> None:
        self.bytes, self.nodes = bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node) -> bool:
        """False if a larger layout is needed."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return True
        if len(self.nodes) == self.room:
            return False
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return zip(self.bytes, self.nodes, strict=True)


class Layout16(Layout4):
    room = 16


class Layout48:
    """A byte of index per key byte, 0 for none, and up to 48 children in any order."""

    room = 48

    def __init__(self) -> None:
        self.slots, self.nodes = bytearray(256), []

    def get(self, byte: int):
        return self.nodes[self.slots[byte] - 1] if self.slots[byte] else None

    def put(self, byte: int, node) -> bool:
        if self.slots[byte]:
            self.nodes[self.slots[byte] - 1] = node
        elif len(self.nodes) == self.room:
            return False
        else:
            self.nodes.append(node)
            self.slots[byte] = len(self.nodes)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((b, self.nodes[s - 1]) for b, s in enumerate(self.slots) if s)


class Layout256:
    """A place per key byte."""

    def __init__(self) -> None:
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


LARGER = {Layout4: Layout16, Layout16: Layout48, Layout48: Layout256}


class Node:
    """``path`` is the compressed run of key bytes that leads here, ``sums`` what the
    members brought for each turn-aligned depth on it."""

    __slots__ = ("below", "path", "sums")

    def __init__(self, path: bytes, sums: list[list]) -> None:
        self.path, self.sums, self.below = path, sums, Layout4()

    def put(self, node: Node) -> None:
        while not self.below.put(node.path[0], node):
            wide = LARGER[type(self.below)]()
            for byte, child in self.below.items():
                wide.put(byte, child)
            self.below = wide


def _add(into: list[list], brought: list[list]) -> None:
    for have, new in zip(into, brought, strict=True):
        have[0] += new[0]
        have[1] += new[1]
        have[2] += new[2]
        have[3] = min(have[3], new[3])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class RadixTree:
    """An adaptive radix tree over keys of whole ids. A key may end where others go on:
    the node it ends at is split off at that depth."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.root = width, Node(b"", [])

    def insert(self, key: bytes, brought: list[list]) -> None:
        """``brought[k]`` is added at depth ``k + 1`` ids: three sums, a minimum and the
        length of the turn."""
        node, at, width = self.root, 0, self.width
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                node.put(Node(key[at:], [list(x) for x in brought[at // width:]]))
                return
            same = _common(child.path, key[at:at + len(child.path)])
            if same < len(child.path):
                # Depths on the upper part of the path: those aligned up to ``same``.
                upper = (at + same) // width - at // width
                top = Node(child.path[:same], child.sums[:upper])
                child.path, child.sums = child.path[same:], child.sums[upper:]
                top.put(child)
                node.put(top)
                child = top
            _add(child.sums, brought[at // width:(at + same) // width])
            node, at = child, at + same

    def nodes(self) -> Iterator[tuple[bytes, list]]:
        """``(ids up to the node, sums)`` of every turn-aligned depth, in key order."""
        stack = [(b"", child) for _, child in reversed(list(self.root.below.items()))]
        while stack:
            lead, node = stack.pop()
            end = lead + node.path
            first = len(lead) // self.width + 1
            for k, sums in enumerate(node.sums):
                yield end[:(first + k) * self.width], sums
            stack += [(end, child) for _, child in reversed(list(node.below.items()))]


def _name(start: tuple[int, int], segment: int, ids: bytes) -> tuple[int, int]:
    """The fingerprint of the node that ``ids`` lead to from a segment's start."""
    d = hashlib.md5(f"{segment}:{ids.hex().upper()}".encode()).digest()
    return start[0] ^ int.from_bytes(d[:8], "big", signed=True), start[1] ^ int.from_bytes(d[8:], "big", signed=True)


def _named(half: int) -> Column:
    """Half of the fingerprint that a whole segment adds, as ``_name`` does."""
    digest = F.md5(F.concat(F.col("segment").cast("string"), F.lit(":"), F.hex("ids")))
    return F.conv(F.substring(digest, 1 + 16 * half, 16), 16, -10).cast("long")


_EMITTED = "ka long, kb long, depth long, pa long, pb long, chars long, s1 long, s2 long, s3 long, least long"


def _emit(second: bool):
    """Trees over the segments of a task. First pass: members, characters of the members
    from the node on, members that end there, smallest member. Second pass: characters
    of distinct nodes below, leaves below."""
    kinds = [n.split() for n in _EMITTED.split(", ")]

    def table(tree: RadixTree) -> Iterator[pa.RecordBatch]:
        rows, lead, name = [], None, None
        for key, sums in tree.nodes():
            depth = len(key) // WIDTH - 2
            if depth < 0:
                continue
            segment, ids = int.from_bytes(key[:WIDTH], "big"), key[2 * WIDTH:]
            if depth == 0 and segment:
                continue
            start = (int.from_bytes(key[WIDTH:WIDTH + 8], "big", signed=True), int.from_bytes(key[WIDTH + 8:2 * WIDTH], "big", signed=True))
            # Nodes come in key order: the parent is mostly the node just named.
            above = None if depth == 0 else start if depth == 1 else name if lead == key[:-WIDTH] else _name(start, segment, ids[:-WIDTH])
            name = _name(start, segment, ids) if depth else start
            lead = key
            rows.append((*name, segment * SEGMENT + depth, *(above or (None, None)), sums[4], sums[0], sums[1], sums[2], sums[3]))
            if len(rows) == 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(kinds))], names=[n for n, _ in kinds])

    def brought(row: dict) -> list[list]:
        """For the segment mark, the start and every turn."""
        conv, lens, segment = row["conv_id"], row["lens"], row["segment"]
        from_here = sum(lens) + row["after"]
        out = [[0, 0, 0, conv, 0]]
        for k, chars in enumerate([0, *lens]):
            depth = segment * SEGMENT + k
            if second:
                out.append([row["run"] if depth <= row["k"] else from_here, row["leaf"], 0, conv, chars])
            else:
                out.append([1, from_here, int(row["last"] and k == len(lens)), conv, chars])
            from_here -= chars
        return out

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = RadixTree(), 0
        for batch in batches:
            for row in batch.to_pylist():
                start = b"".join(row[c].to_bytes(8, "big", signed=True) for c in ("sa", "sb"))
                tree.insert(row["segment"].to_bytes(WIDTH, "big") + start + row["ids"], brought(row))
                held += len(row["lens"])
                if held > TREE_TURNS:
                    yield from table(tree)
                    tree, held = RadixTree(), 0
        yield from table(tree)

    return emit


def _trees(segments: DataFrame, second: bool) -> DataFrame:
    """Nodes of all segments, added up."""
    order = ["segment", "sa", "sb", "ids", "conv_id"]
    part = segments.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_emit(second), _EMITTED)
    return part.groupBy("ka", "kb").agg(
        F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("chars").alias("chars"),
        F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("s3").alias("s3"), F.min("least").alias("conv_id"))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lists of each node, which come in order."""
    key, state, done = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["ka"], row["kb"]) != key:
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (row["ka"], row["kb"]), hashlib.sha256()
                state.update(row["ids"].encode())
            else:
                state.update(f",{row['ids']}".encode())
    if state:
        done.append((*key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                     names=["ka", "kb", "ends_sha256"])


def segments_of(turns: DataFrame) -> DataFrame:
    """Chains cut into segments, from ``conv_id, pos, id, chars``, pos gapless from 0; a
    conversation without turns is one row with null ``id``. ``sa, sb`` name the node a
    segment starts at, ``ea, eb`` that where it ends, ``after`` counts the characters of
    later segments."""
    cut = turns.withColumn("segment", F.floor(F.coalesce("pos", F.lit(0)) / SEGMENT).cast("long"))
    # At most SEGMENT turns to a list.
    rows = cut.groupBy("conv_id", "segment").agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id", "chars")))).alias("t"))
    rows = rows.select("conv_id", "segment", F.unhex(F.array_join(F.transform("t.id", F.hex), "")).alias("ids"),
                       F.col("t.chars").alias("lens"), F.aggregate("t.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("own"))
    down = Window.partitionBy("conv_id").orderBy("segment")
    back = Window.partitionBy("conv_id").orderBy(F.col("segment").desc())
    for name, half in (("a", 0), ("b", 1)):
        so_far = F.bit_xor(_named(half)).over(down)
        # Of a turnless conversation start and end are the root.
        rows = rows.withColumn(f"e{name}", F.when(F.size("lens") > 0, so_far).otherwise(0))
    before = F.lag("ea").over(down), F.lag("eb").over(down)
    return rows.select("conv_id", "segment", "ids", "lens", F.coalesce(before[0], F.lit(0)).alias("sa"), F.coalesce(before[1], F.lit(0)).alias("sb"),
                       "ea", "eb", (F.sum("own").over(back) - F.col("own")).alias("after"), (F.row_number().over(back) == 1).alias("last"))


def trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of chains ``conv_id, pos, id, chars`` (see ``segments_of``), a row per
    node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Without conversations
    there is no node, not even the root. Equal chains share all nodes; two turns are one
    if their ids are."""
    segments = stage(segments_of(turns), "segments")
    nodes = stage(_trees(segments, False), "nodes")
    # Every conversation that is the smallest member of nodes, with the run of these.
    runs = nodes.groupBy("conv_id").agg(F.min("depth").alias("k"), F.max(F.when(F.col("s1") == F.col("s3"), 1).otherwise(0)).cast("long").alias("leaf"))
    whole = Window.partitionBy("conv_id")
    depth = F.col("segment") * SEGMENT
    own = F.expr("aggregate(slice(lens, cast(greatest(k - _at, 1) as int), size(lens)), 0L, (a, x) -> a + x)")
    second = segments.join(runs, "conv_id").withColumn("_at", depth).withColumn("run", F.sum(own).over(whole)).drop("_at")
    below = _trees(second, True)
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    ends = segments.where("last").groupBy(F.col("ea").alias("ka"), F.col("eb").alias("kb"), F.floor(F.col("conv_id") / IDS).alias("list")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ends.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "list").mapInArrow(_join_ids, "ka long, kb long, ends_sha256 string")
    # Inside a run the parent has the same smallest member; its first node looks it up.
    heads = nodes.join(runs.select("conv_id", "k"), "conv_id").where("depth = k and depth > 0")
    parents = heads.select("ka", "kb", F.col("pa"), F.col("pb")).join(
        nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id")), ["pa", "pb"])
    every = nodes.select("ka", "kb", "depth", "conv_id", F.col("s1").alias("n_convs"), F.col("s2").alias("chars")).unionByName(
        below.select("ka", "kb", F.col("s1").alias("distinct"), F.col("s2").alias("n_leaves")), allowMissingColumns=True).unionByName(
        children, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True).unionByName(
        parents.select("ka", "kb", "parent_conv_id"), allowMissingColumns=True)
    one = every.groupBy("ka", "kb").agg(*(F.max(c).alias(c) for c in every.columns if c not in ("ka", "kb")))
    return one.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", (F.col("chars") - F.col("distinct")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def chains(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, id, chars`` of every turn (see ``turns.numbered``); rows with a null
    conv_id belong to no conversation and are left out."""
    rows = numbered(conversations.where("conv_id is not null"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return rows.select("conv_id", "pos", F.unhex(F.left(digest, F.lit(2 * WIDTH))).alias("id"), F.length("text").cast("long").alias("chars"))


def regrafted(turns: DataFrame, step: int = 100, most: int = 5) -> DataFrame:
    """Chains whose beginnings come from others: conversation c starts with the first h
    turns of conversation c - c % step and goes on after its own first h, h being
    crc32(c) % (most + 1). Every conversation stays, without turns where nothing is left."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % step
    # At most ``most`` turns to a list, and one list per ``step`` conversations.
    heads = turns.where((F.col("conv_id") % step == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "chars"))).alias("head"))
    convs = turns.select("conv_id").distinct().select("conv_id", h.cast("int").alias("h"), base.alias("base")).join(heads, "base", "left").select(
        "conv_id", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,id:binary,chars:bigint>>")), F.lit(1), F.col("h")).alias("head"))
    grafted = convs.select("conv_id", F.explode_outer("head").alias("t")).select("conv_id", "t.pos", "t.id", "t.chars")
    rest = turns.where(F.col("pos") >= h).withColumn("h", h).join(convs.select("conv_id", F.size("head").alias("had")), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("had")).alias("pos"), "id", "chars")
    return grafted.union(rest)
