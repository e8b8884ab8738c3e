"""Prefix trie of conversations, built from adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes (md5 of role and text), so a conversation is a binary key of turn ids in order. The keys
are range-sorted into shards; every shard holds its run of keys in an adaptive radix tree whose nodes grow
through layouts of 4, 16, 48 and 256 children and whose one-way paths are compressed. Only byte depths that are
whole turns become nodes of the trie; branches inside an id belong to the turn-aligned node above them.

Plan: texts are hashed and counted where they stand and never move. Conversations that are the same form one key;
their ids are range-sorted by (key, id), so a group of any size is spread over tasks, and packed into runs of
``PACK`` ids, which the key's shard streams through one digest. Nodes that stand on the path of a shard's first or
last key may go on in the next shard ("open"); all others are whole. Open nodes are merged by grouped sums; what
their subtrees hold is summed along the paths (spines) of the shards' end keys, each open node counted on one
of its spines. There are at most two paths of open nodes a shard.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), equal turns by their ids, and
repeated rows are turns of their own; rows with a null conv_id belong to no conversation; a conversation without
turns is a member of the root only; a very long conversation is one row of 28 bytes a turn; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import broadcast_if_bounded, prepare, stored

WIDTH = 16
PACK = 4096
SHARD_KEYS = 100_000
EMITTED = 10_000
LAYOUTS = (4, 16, 48, 256)
ROOT = "root"

HEAD_TURNS = 6
HEAD_SPAN = 100


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn; the length of the role keeps role and text apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: turns, an array of (turn, id, chars) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", turn_id(role, text).alias("id"), F.length(text).alias("chars")).alias("one"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_shared_heads(sequences: DataFrame) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the first of its hundred.

    h is crc32 of the decimal id modulo 6; where that conversation is shorter or absent, fewer turns stand there.
    """
    base = sequences.where(F.col("conv_id") % HEAD_SPAN == 0)
    heads = base.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD_TURNS - 1).alias("head"))
    own = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % HEAD_SPAN)
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    both = own.join(heads, "base", "left").withColumn("h", taken)
    no_turns = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", no_turns), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


class Node:
    """A node of the radix tree: the compressed bytes before it, what ends at it, and children by next byte.

    Up to 4 and 16 children: their bytes in ``index``, in no order. Up to 48: ``index`` has 256 places with a child's
    number, from 1. Beyond: ``index`` is None and ``children`` has a place for every byte.
    """

    __slots__ = ("path", "end", "layout", "index", "children")

    def __init__(self, path: bytes, end: End | None = None):
        self.path, self.end, self.layout = path, end, LAYOUTS[0]
        self.index: bytearray | None = bytearray()
        self.children: list[Node | None] = []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Adds a child or replaces that of the same byte."""
        if self.layout <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if len(self.children) == self.layout:
                self._grow()
                self.put(byte, child)
                return
            self.index.append(byte)
            self.children.append(child)
        elif self.layout == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = child
                return
            if len(self.children) == self.layout:
                self._grow()
                self.put(byte, child)
                return
            self.children.append(child)
            self.index[byte] = len(self.children)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        held = self.items()
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 48:
            self.index, self.children = bytearray(256), [c for _, c in held]
            for at, (byte, _) in enumerate(held):
                self.index[byte] = at + 1
        elif self.layout == 256:
            self.index, self.children = None, [None] * 256
            for byte, child in held:
                self.children[byte] = child

    def items(self) -> list[tuple[int, Node]]:
        """Children by byte, ascending."""
        if self.layout <= 16:
            return sorted(zip(self.index, self.children), key=lambda pair: pair[0])
        if self.layout == 48:
            return [(byte, self.children[at - 1]) for byte, at in enumerate(self.index) if at]
        return [(byte, child) for byte, child in enumerate(self.children) if child]


@dataclass
class End:
    """The conversations that end with one key: how many, the smallest, the digest of their ids, and chars by turn."""

    n: int
    low: int
    digest: str
    chars: list[int]


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, end: End) -> None:
        above, byte, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                common = 0
                while at + common < len(key) and key[at + common] == path[common]:
                    common += 1
                upper = Node(path[:common])
                upper.put(path[common], node)
                node.path = path[common + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node, path = upper, upper.path
            at += len(path)
            if at == len(key):
                node.end = end
                return
            above, byte, child = node, key[at], node.child(key[at])
            if child is None:
                node.put(byte, Node(key[at + 1 :], end))
                return
            node, at = child, at + 1


def _chain(above: str, turn: bytes) -> str:
    """Id of the node that adds a turn to another; the same in every shard."""
    return hashlib.md5((above + turn.hex()).encode()).hexdigest()


def path_ids(key: bytes) -> list[str]:
    """Ids of all nodes on the way of a key, the root first."""
    out = [ROOT]
    for at in range(0, len(key), WIDTH):
        out.append(_chain(out[-1], key[at : at + WIDTH]))
    return out


@dataclass
class Sums:
    """What the topmost turn-aligned nodes below some place hold; closed ones only in the last three."""

    n: int = 0
    low: int | None = None
    tops: int = 0
    leaves: int = 0
    saved: int = 0

    def add(self, other: Sums) -> None:
        self.n += other.n
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.tops, self.leaves, self.saved = self.tops + other.tops, self.leaves + other.leaves, self.saved + other.saved


@dataclass
class _Visit:
    """One radix node during the walk: its turn-aligned nodes, deepest last, and the sums of its children so far."""

    node: Node
    aligned: list[int]
    ends_here: bool
    todo: list[tuple[int, Node]]
    tail: bytes
    last: int
    sums: Sums = field(default_factory=Sums)
    chars: list[int] | None = None


def trie_nodes(tree: RadixTree, open_ids: set[str]) -> list[dict]:
    """The turn-aligned nodes of a tree, parents first.

    For an open node n_children, n_leaves and saved_tokens count its closed children and their subtrees only.
    """
    out: list[dict] = []

    def visit(node: Node, edge: bytes, last: int) -> _Visit:
        """Enters a radix node over ``edge``, all bytes since the turn-aligned node ``last`` (-1: above the root)."""
        aligned = []
        if last < 0:
            out.append({"id": ROOT, "parent": None, "depth": 0, "open": True})
            aligned, last = [0], 0
        while len(edge) >= WIDTH:
            name = _chain(out[last]["id"], edge[:WIDTH])
            out.append({"id": name, "parent": last, "depth": out[last]["depth"] + 1, "open": name in open_ids})
            last, edge = len(out) - 1, edge[WIDTH:]
            aligned.append(last)
        return _Visit(node, aligned, bool(aligned) and not edge, node.items(), edge, last)

    def leave(v: _Visit) -> Sums:
        """Fills the aligned nodes of a visit from the deepest up and returns what the place above sees."""
        sums, end = v.sums, v.node.end
        if end is not None:
            sums.add(Sums(end.n, end.low))
            v.chars = end.chars
        for k, at in enumerate(reversed(v.aligned)):
            row = out[at]
            digest = end.digest if end is not None and k == 0 and v.ends_here else None
            chars = v.chars[row["depth"] - 1] if row["depth"] else 0
            row |= {"n": sums.n, "low": sums.low, "chars": chars, "digest": digest}
            row |= {"children": sums.tops, "leaves": sums.leaves, "saved": sums.saved}
            if row["open"]:
                sums = Sums(sums.n, sums.low)
            else:
                row["leaves"] += not sums.tops
                row["saved"] += (sums.n - 1) * chars
                sums = Sums(sums.n, sums.low, 1, row["leaves"], row["saved"])
        return sums

    stack = [visit(tree.root, tree.root.path, -1)]
    while stack:
        v = stack[-1]
        if v.todo:
            byte, child = v.todo.pop()
            stack.append(visit(child, v.tail + bytes([byte]) + child.path, v.last))
        else:
            stack.pop()
            sums = leave(v)
            if stack:
                stack[-1].sums.add(sums)
                stack[-1].chars = stack[-1].chars or v.chars
    return out


_NODE = pa.schema(
    [("id", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("open", pa.bool_()), ("conv_id", pa.int64())]
    + [("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64())]
    + [("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends_sha256", pa.string()), ("spines", pa.list_(pa.int64()))]
)
_NODE_KIND = (
    "id string, parent string, depth long, open boolean, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, spines array<long>"
)


def _rows(nodes: list[dict], first: list[str], last: list[str], shard: int) -> Iterator[pa.RecordBatch]:
    """Nodes as rows; an open node names the spines it stands on, a closed one its parent's conv_id where that is known."""
    spines: dict[str, list[int]] = {}
    for side, ids in ((0, first), (1, last)):
        for name in ids:
            spines.setdefault(name, []).append(2 * shard + side)
    for begin in range(0, len(nodes), EMITTED):
        rows = []
        for row in nodes[begin : begin + EMITTED]:
            above = None if row["parent"] is None else nodes[row["parent"]]
            known = above is not None and not above["open"]
            rows.append(
                {
                    "id": row["id"], "parent": None if above is None or known else above["id"], "depth": row["depth"],
                    "open": row["open"], "conv_id": row["low"], "parent_conv_id": above["low"] if known else None,
                    "n_convs": row["n"], "n_children": row["children"], "n_leaves": row["leaves"],
                    "saved_tokens": row["saved"], "chars": row["chars"], "ends_sha256": row["digest"],
                    "spines": spines.get(row["id"]) if row["open"] else None,
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_NODE)


def _packs(sequences: DataFrame, shards: int) -> DataFrame:
    """(key, chars, first, n, ids): up to ``PACK`` conversations with one key, ids ascending and comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chars, ids = None, None, []

        def row() -> pa.RecordBatch:
            one = {"key": key, "chars": chars, "first": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))}
            return one

        schema = pa.schema([("key", pa.binary()), ("chars", pa.list_(pa.int32())), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            done = []
            columns = (batch.column(n).to_pylist() for n in ("key", "chars", "conv_id"))
            for new, sizes, conv in zip(*columns):
                if ids and (new != key or len(ids) == PACK):
                    done.append(row())
                    ids = []
                key, chars = new, sizes
                ids.append(conv)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if ids:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    keyed = sequences.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    placed = keyed.repartitionByRange(shards, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return placed.mapInArrow(pack, "key binary, chars array<int>, first long, n long, ids string")


def _shard_nodes(packs: DataFrame, shards: int) -> DataFrame:
    """Closed nodes, whole, and the parts of open nodes, from one radix tree a shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree, first, key, end, digest = RadixTree(), None, None, None, None
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("key", "chars", "first", "n", "ids"))
            for new, chars, low, n, ids in zip(*columns):
                if end is not None and new == key:
                    digest.update(b",")
                else:
                    if end is not None:
                        end.digest = digest.hexdigest()
                        tree.insert(key, end)
                    first = new if first is None else first
                    key, end, digest = new, End(0, low, "", chars), hashlib.sha256()
                digest.update(ids.encode())
                end.n += n
        if end is not None:
            end.digest = digest.hexdigest()
            tree.insert(key, end)
            low, high = path_ids(first), path_ids(key)
            yield from _rows(trie_nodes(tree, {*low, *high}), low, high, TaskContext.get().partitionId())

    placed = packs.repartitionByRange(shards, "key").sortWithinPartitions("key", "first")
    return placed.mapInArrow(build, _NODE_KIND)


def _merged_open(parts: DataFrame) -> DataFrame:
    """The open nodes, each once, with whole counts and the sums of their subtrees."""
    nodes = parts.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"), F.max("ends_sha256").alias("ends_sha256"),
        F.min(F.array_min("spines")).alias("owner"),
    )
    below = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(below, "id", "left").withColumn("n_children", F.col("closed") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long"))
    nodes = stored(nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")), "open-nodes")
    on_spine = parts.select("id", F.explode("spines").alias("spine"))
    valued = on_spine.join(nodes.select("id", "depth", "owner", "leaves", "saved"), "id")
    mine = F.col("spine") == F.col("owner")
    downward = Window.partitionBy("spine").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    along = valued.select(
        "id",
        F.sum(F.when(mine, F.col("leaves")).otherwise(0)).over(downward).alias("leaves"),
        F.sum(F.when(mine, F.col("saved")).otherwise(0)).over(downward).alias("saved"),
    )
    whole = along.groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return nodes.drop("leaves", "saved").join(whole, "id")


RESULT = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def prefix_trie(sequences: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, turns), the root included.

    conv_id is the smallest member; parent_conv_id that of the parent, null for the root; n_leaves and saved_tokens
    cover the subtree; ends_sha256 is the digest of the ids of the members that end at the node.
    """
    spark = sequences.sparkSession
    prepare(spark)
    sequences = stored(sequences, "turn-sequences")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sequences.count() // shard_keys))
    packs = stored(_packs(sequences, shards), "turn-packs")
    parts = stored(_shard_nodes(packs, shards), "trie-parts")
    whole = stored(_merged_open(parts.where("open")), "open-whole")
    names = broadcast_if_bounded(whole.select(F.col("id").alias("above"), F.col("conv_id").alias("above_conv")))
    closed = parts.where("not open")
    inner = closed.where("parent is null").select(*RESULT)
    edge = closed.where("parent is not null").unionByName(whole, allowMissingColumns=True)
    edge = edge.join(names, F.col("parent") == F.col("above"), "left")
    edge = edge.withColumn("parent_conv_id", F.col("above_conv")).select(*RESULT)
    nothing = hashlib.sha256().hexdigest()
    return inner.unionByName(edge).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
