"""Prefix trie of rebuilt conversations: adaptive radix trees over turn ids.

Rebuilding: a conversation c takes the first h turns of conversation c - c % 5 (all it has, none if it is absent), then its own turns
after its first h; h is the CRC-32 of the decimal c modulo 9. Turns are ordered by turn (null first), equal turns by role and text;
repeated rows are turns of their own. A null role or text is empty. Rows without a conv_id belong to no conversation and take no
part. Only conv_id, turn, role and text are read, so further columns may have any name. An empty table has no node, not even a root.
A conversation left without turns is a member of the root alone.

A turn's id is a 16-byte digest of role and text; texts leave the plan after they are hashed and put in order. A conversation is the
byte string of its turn ids, cut into segments (SEGMENT turns): a segment starts at the node that all turns before it lead to, so a
conversation of any length is dealt out over many tasks. Segments are range-partitioned by (start node, bytes, conv_id), which splits
any number of copies of one conversation; every task builds adaptive radix trees of bounded size (nodes of 4, 16, 48 or 256 children,
compressed paths) and emits one row for each turn-aligned depth, which are then summed by node digest.

Sums over subtrees need no recursion. A node is owned by its smallest member, who then owns all deeper nodes on its own path. A first
pass finds nodes, members and owners. In a second pass each member carries to every node on its path whether it owns a childless
node, and the bytes of the deeper turns whose nodes it does not own: their sums are n_leaves and saved_tokens.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgauge.llm.common import ranked, stored

ID = 16
SEGMENT = 256
TREE_KEYS = 50_000
TREE_BYTES = 32 << 20
CHUNK = 64 << 10
ROOT = bytes(ID)
FAR = 1 << 62


class Node:
    """A node whose children stand in a layout that grows with their number: sorted lists (4, 16), a byte index (48), a full table (256)."""

    __slots__ = ("kids", "keys", "leaves", "least", "members", "prefix", "size", "tail", "top")

    def __init__(self, prefix: bytes):
        self.prefix, self.size, self.keys, self.kids = prefix, 4, [], []
        self.members, self.least, self.top, self.leaves, self.tail = 0, FAR, FAR, 0, 0  # of the conversations that end here

    def child(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = bisect.bisect_left(self.keys, byte)
            return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.size == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Set the child under `byte`."""
        if self.size <= 16:
            at = bisect.bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = node
                return
            if len(self.keys) < self.size:
                self.keys.insert(at, byte)
                self.kids.insert(at, node)
                return
            self._grow()
            self.put(byte, node)
        elif self.size == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.keys[byte] = len(self.kids)
            else:
                self._grow()
                self.put(byte, node)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        pairs = list(self.children())
        self.size = {4: 16, 16: 48, 48: 256}[self.size]
        if self.size == 48:
            self.keys = bytearray(256)
            for at, (byte, _) in enumerate(pairs):
                self.keys[byte] = at + 1
        elif self.size == 256:
            table: list[Node | None] = [None] * 256
            for byte, node in pairs:
                table[byte] = node
            self.keys, self.kids = b"", table

    def children(self) -> Iterator[tuple[int, Node]]:
        if self.size <= 16:
            yield from zip(self.keys, self.kids, strict=True)
        elif self.size == 48:
            yield from ((b, self.kids[at - 1]) for b, at in enumerate(self.keys) if at)
        else:
            yield from ((b, k) for b, k in enumerate(self.kids) if k is not None)


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    if b.startswith(a, at):
        return len(a)
    return next(i for i in range(len(a)) if at + i >= len(b) or a[i] != b[at + i])


class Tree:
    """Adaptive radix tree of byte strings whose length is a multiple of ID."""

    def __init__(self):
        self.root: Node | None = None
        self.keys = self.bytes = 0
        self.weights: dict[bytes, int] = {}

    def insert(self, key: bytes, sizes: list[int], conv: int, top: int, leaf: int, tail: int) -> None:
        """Add a conversation: its turn sizes, the depth down to which others own its nodes, whether it owns a leaf, bytes saved beyond this segment."""
        self.keys += 1
        self.bytes += len(key)
        self.weights.update(zip((key[i : i + ID] for i in range(0, len(key), ID)), sizes, strict=True))
        node = self._at(key)
        node.members += 1
        node.least, node.top = min(node.least, conv), min(node.top, top)
        node.leaves += leaf
        node.tail += tail

    def _at(self, key: bytes) -> Node:
        if self.root is None:
            self.root = Node(key)
            return self.root
        node, above, byte, depth = self.root, None, 0, 0
        while True:
            same = _common(node.prefix, key, depth)
            if same < len(node.prefix):
                split = Node(node.prefix[:same])
                split.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                if above is None:
                    self.root = split
                else:
                    above.put(byte, split)
                node = split
            depth += same
            if depth == len(key):
                return node
            above, byte = node, key[depth]
            following = node.child(byte)
            if following is None:
                following = Node(key[depth + 1 :])
                node.put(byte, following)
                return following
            node, depth = following, depth + 1

    def rows(self, start: bytes, begin: int) -> Iterator[tuple]:
        """node, parent, depth, bytes, members, least member, leaves, saved of every turn-aligned depth; `begin` turns lead to `start`."""
        if self.root is None:
            return
        stack, order = [(self.root, self.root.prefix, 0, -1)], []
        while stack:
            node, path, first, above = stack.pop()
            order.append((node, path, first, above))
            me = len(order) - 1
            stack += [(kid, path + bytes([byte]) + kid.prefix, len(path), me) for byte, kid in node.children()]
        sums = [[x[0].members, x[0].least, x[0].top, x[0].leaves, x[0].tail] for x in order]
        for me in range(len(order) - 1, -1, -1):
            _, path, first, above = order[me]
            members, least, top, leaves, saved = sums[me]
            for turns in range(len(path) // ID, first // ID, -1):
                weight = self.weights[path[(turns - 1) * ID : turns * ID]]
                saved += (members - (begin + turns > top)) * weight
                yield node_id(start, path[: turns * ID]), node_id(start, path[: (turns - 1) * ID]), begin + turns, weight, members, least, leaves, saved
            if above >= 0:
                into = sums[above]
                into[0] += members
                into[1], into[2] = min(into[1], least), min(into[2], top)
                into[3] += leaves
                into[4] += saved
            elif not begin:
                yield ROOT, None, 0, 0, members, least, leaves, saved


def node_id(start: bytes, path: bytes) -> bytes:
    """The node that the turn ids `path` lead to from the node `start`."""
    return hashlib.sha256(start + hashlib.sha256(path).digest()[:ID]).digest()[:ID] if path else start


def _node_id(start: Column, path: Column) -> Column:
    short = F.substring(F.unhex(F.sha2(path, 256)), 1, ID)
    return F.when(F.length(path) == 0, start).otherwise(F.substring(F.unhex(F.sha2(F.concat(start, short), 256)), 1, ID))


NODES = "node binary, parent binary, depth long, bytes long, members long, conv_id long, leaves long, saved long"
_NODES = pa.schema([("node", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "bytes", "members", "conv_id", "leaves", "saved"))])


def _grown(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Node rows of the trees over segments sorted by their start node."""

    def emptied(tree: Tree, start: bytes, begin: int) -> Iterator[pa.RecordBatch]:
        rows = tree.rows(start, begin)
        while some := list(itertools.islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _NODES, strict=True)], schema=_NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, here = Tree(), None
        for batch in batches:
            for start, seg, *rest in zip(*(batch.column(c).to_pylist() for c in ("start", "seg", "key", "sizes", "conv_id", "top", "leaf", "tail")), strict=True):
                if here is not None and (here[0] != start or tree.keys >= TREE_KEYS or tree.bytes >= TREE_BYTES):
                    yield from emptied(tree, *here)
                    tree = Tree()
                here = (start, seg * segment)
                tree.insert(*rest)
        if here is not None:
            yield from emptied(tree, *here)

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start node of every segment from the segments' digests in order; one node is remembered."""
    conv, node = None, ROOT
    for batch in batches:
        out = []
        for c, short in zip(batch.column("conv_id").to_pylist(), batch.column("short").to_pylist(), strict=True):
            node = node if c == conv else ROOT
            conv = c
            out.append(node)
            node = hashlib.sha256(node + short).digest()[:ID]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), pa.array(out, pa.binary())], ["conv_id", "seg", "start"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (turns of the conversation), id, bytes of every turn in order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    whole = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"id": F.substring(F.unhex(whole), 1, ID), "bytes": F.octet_length("text").cast("long")})
    placed = ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv_id", "id", "bytes"], "trie-turns")
    return placed.withColumn("pos", F.col("pos") + 1)


def taken(conv: str) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % 9).cast("int")


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv_id, d, id, bytes of all rebuilt turns, and a row of depth 0 without id for every conversation."""
    convs = stored(placed.groupBy("conv_id").agg(F.max("n").alias("n")), "trie-convs")
    heads = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), taken("conv_id").alias("h"))
    first = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    heads = heads.join(first, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent"))
    given = placed.where("conv_id % 5 = 0 AND pos <= 8").select(F.col("conv_id").alias("base"), "pos", "id", "bytes")
    lent = heads.where("lent > 0").join(given, "base").where("pos <= lent").select("conv_id", F.col("pos").alias("d"), "id", "bytes")
    own = placed.where(F.col("pos") > taken("conv_id")).join(heads.select("conv_id", (F.col("h") - F.col("lent")).alias("gap")), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("gap")).alias("d"), "id", "bytes")
    zero = heads.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("bytes"))
    return lent.union(own).union(zero)


def segments(built: DataFrame, segment: int) -> DataFrame:
    """conv_id, seg, start, key, sizes, ends: every conversation in segments of `segment` turns, each with the node it starts from."""
    seg = F.floor(F.greatest(F.col("d") - 1, F.lit(0)) / segment).alias("seg")
    rows = built.groupBy("conv_id", seg).agg(F.sort_array(F.collect_list(F.struct("d", "id", "bytes"))).alias("t"))
    rows = rows.withColumn("t", F.filter("t", lambda x: x["d"] > 0))
    key = F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["id"]))
    rows = stored(rows.select("conv_id", "seg", key.alias("key"), F.transform("t", lambda x: x["bytes"]).alias("sizes")), "trie-segments")
    several = rows.groupBy("conv_id").agg(F.max("seg").alias("last"))
    short = F.substring(F.unhex(F.sha2("key", 256)), 1, ID).alias("short")
    chain = rows.join(several.where("last > 0").select("conv_id"), "conv_id").select("conv_id", "seg", short)
    chain = chain.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_starts, "conv_id long, seg long, start binary")
    whole = rows.join(several, "conv_id").join(chain, ["conv_id", "seg"], "left")
    return whole.select("conv_id", "seg", F.coalesce("start", F.lit(ROOT)).alias("start"), "key", "sizes", (F.col("seg") == F.col("last")).alias("ends"))


def grown(segs: DataFrame, segment: int) -> DataFrame:
    """Node rows of every task's trees over `segs` (start, seg, key, sizes, conv_id, top, leaf, tail), still to be summed by node."""
    along = segs.select("start", "seg", "key", "sizes", "conv_id", "top", "leaf", "tail").repartitionByRange("start", "key", "conv_id")
    return along.sortWithinPartitions("start", "key").mapInArrow(_grown(segment), NODES)


def _id_texts(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Decimal conversation ids of neighbouring rows of one node, joined by commas in pieces of about `chunk` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, size = None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], ["node", "first", "ids"])

        for batch in batches:
            for at, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (at != node or size >= chunk):
                    yield piece()
                    held, size = [], 0
                node = at
                held.append(conv)
                size += len(str(conv)) + 1
        if held:
            yield piece()

    return run


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of every node in order; only the hash state is held."""
    node, state = None, None
    for batch in batches:
        nodes, found = [], []
        for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is not None and at == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                nodes.append(node)
                found.append(state.hexdigest())
            node, state = at, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])


def end_digests(segs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, ends_sha256 of every node where conversations end."""
    ends = segs.where("ends").select(_node_id(F.col("start"), F.col("key")).alias("node"), "conv_id")
    texts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_id_texts(chunk), "node binary, first long, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_id_digests, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    segs = stored(segments(rebuilt(turns(conversations)), segment), "trie-segments")
    none = {"top": F.lit(FAR), "leaf": F.lit(0).cast("long"), "tail": F.lit(0).cast("long")}
    found = grown(segs.withColumns(none), segment).groupBy("node")
    nodes = found.agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stored(nodes, "trie-nodes")
    below = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    nodes = stored(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")

    owners = nodes.groupBy("conv_id").agg((F.min("depth") - 1).alias("top"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf"))
    owned = segs.join(owners, "conv_id", "left").withColumns({"top": F.coalesce("top", F.lit(FAR)), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    shared = F.greatest(F.lit(0), F.least(F.size("sizes").cast("long"), F.col("top") - F.col("seg") * segment)).cast("int")
    lost = F.aggregate(F.slice("sizes", F.lit(1), shared), F.lit(0).cast("long"), lambda a, x: a + x)
    later = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(1, Window.unboundedFollowing)
    many = owned.where((F.col("seg") > 0) | ~F.col("ends")).select("conv_id", "seg", lost.alias("lost"))
    tails = many.select("conv_id", "seg", F.coalesce(F.sum("lost").over(later), F.lit(0).cast("long")).alias("tail"))
    owned = owned.join(tails, ["conv_id", "seg"], "left").withColumn("tail", F.coalesce("tail", F.lit(0).cast("long")))
    sums = grown(owned, segment).groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(end_digests(segs), "node", "left").join(above, "parent", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
