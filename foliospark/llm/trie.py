"""Prefix trie of conversations: shared first turns, and what is saved by computing them once.

Conversations are rows of turn names (128 bits of a SHA-256 of role and text), joined to one binary key, so that the
order of keys is that of turn arrays and a prefix sorts right before its extensions. The keys are sorted globally by
range, with the id as the last column, so that a conversation with very many copies is spread over blocks too.

Each block (a sorted partition) is swept once: the common prefix with the row before says which nodes end, and a stack
holds the nodes that are still open. A node is finished in its block unless it lies on the path of the block's first
or last row. Those nodes leave the block as open parts, two paths a block; one task stitches them in block order with the
same kind of stack. So what that task reads follows blocks and turns, not conversations.

A node's parent is named by its place in the block; parents and children meet in a join on (block, place).
The ids of conversations that end in an open node leave in pieces of PIECE ids and are hashed in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved

NAME = 16
#: Ids in a piece of an open node's list; turns in a block, about.
PIECE, BLOCK_TURNS = 1000, 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def named_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, name, words): turns in the order of `turn` (null first, then role and text), null role or text empty.
    Rows without a conversation are left out."""
    d = turns.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("_turn"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "_role"), (text, "_text"))))
    d = d.where("conv is not null")
    pos = F.row_number().over(W.partitionBy("conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")) - 1
    # the role's length keeps role and text apart
    whole = F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text")
    d = d.withColumn("name", F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * NAME)).withColumn("words", F.regexp_count("_text", F.lit(WORD)).cast("long"))
    return d.select("conv", pos.cast("long").alias("pos"), "name", "words")


def conversations(named: DataFrame) -> DataFrame:
    """(conv, key, words): one row a conversation, its turns' names as one binary key and their numbers of words."""
    own = F.array_sort(F.collect_list(F.struct("pos", "name", "words")))
    d = named.groupBy("conv").agg(own.alias("t"))
    return d.select("conv", F.unhex(F.array_join("t.name", "")).alias("key"), F.col("t.words").alias("words"))


class Node:
    """A node of the trie while it is open."""

    __slots__ = ("at", "name", "n", "conv", "words", "kids", "leaves", "saved", "ids", "first")

    def __init__(self, at: int, name: bytes, words: int, first: bool = False) -> None:
        self.at, self.name, self.words, self.first = at, name, words, first
        self.n, self.conv, self.kids, self.leaves, self.saved, self.ids = 0, None, 0, 0, 0, []

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)

    def totals(self) -> tuple[int, int]:
        """Leaves and saved tokens of the subtree, when all children have been added."""
        return self.leaves or 1, self.saved + (self.n - 1) * self.words

    def take(self, child: Node) -> None:
        """Adds what a finished child says of its subtree."""
        leaves, spare = child.totals()
        self.kids += 1
        self.leaves += leaves
        self.saved += spare


_SWEPT = "kind int, block int, place long, parent long, depth long, name binary, words long, n_convs long, conv_id long, kids long, leaves long, saved long, ids string"
DONE, OPEN, IDS = 0, 1, 2
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in text.split(", ")])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema.types)], schema=schema)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    n = min(len(a), len(b)) // NAME
    if a[: n * NAME] == b[: n * NAME]:
        return n
    lo, hi = 0, n  # a common start of lo turns, none of hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[: mid * NAME] == b[: mid * NAME] else (lo, mid)
    return lo


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one block, whose rows (block, key, conv, words) come sorted by key and conv: finished ones with the hash of
    their ids, and open ones with their ids as pieces."""
    schema, out, stack, last, block, places = _schema(_SWEPT), [], [], b"", 0, 0

    def close(still_open: bool) -> None:
        node = stack.pop()
        parent = None
        if stack:
            parent = stack[-1].at
            stack[-1].add(node.n, node.conv)
        head = (block, node.at, parent, len(stack), node.name, node.words, node.n, node.conv)
        if node.first or still_open:
            out.append((OPEN, *head, node.kids, node.leaves, node.saved, None))
            for i in range(0, len(node.ids), PIECE):
                out.append((IDS, block, node.at, i, *[None] * 8, ",".join(node.ids[i : i + PIECE])))
            return
        leaves, spare = node.totals()
        out.append((DONE, *head, node.kids, leaves, spare, hashlib.sha256(",".join(node.ids).encode()).hexdigest()))
        stack[-1].take(node)

    for batch in batches:
        for block, key, conv, words in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "conv", "words"))):
            fresh = not stack
            if fresh:
                stack.append(Node(0, b"", 0, True))
                places = 1
            shared = 0 if fresh else common(last, key)
            while len(stack) > shared + 1:
                close(False)
            for d in range(shared, len(key) // NAME):
                stack.append(Node(places, key[d * NAME : (d + 1) * NAME], words[d], fresh))
                places += 1
            stack[-1].add(1, conv)
            stack[-1].ids.append(str(conv))
            last = key
        if len(out) > 5000:
            yield _rows(out, schema)
            out.clear()
    while stack:
        close(True)
    yield _rows(out, schema)


_STITCHED = "block int, place long, node long, parent long, depth long, n_convs long, conv_id long, kids long, leaves long, saved long"


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins open parts, in the order of block and place, to whole nodes. A row names the node of each part (block, place), with
    nulls after it; and each node has a row without block and place. Parts of a path come from its top down, so that a part with
    the name of the open node of its depth belongs to it, and any other ends what is open from that depth on."""
    schema, out, stack, nodes = _schema(_STITCHED), [], [], 0

    def close() -> None:
        node = stack.pop()
        leaves, spare = node.totals()
        out.append((None, None, node.at, stack[-1].at if stack else None, len(stack), node.n, node.conv, node.kids, leaves, spare))
        if stack:
            stack[-1].take(node)

    for batch in batches:
        for r in batch.to_pylist():
            d = r["depth"]
            if len(stack) <= d or stack[d].name != r["name"]:
                while len(stack) > d:
                    close()
                stack.append(Node(nodes, r["name"], r["words"]))
                nodes += 1
            node = stack[d]
            node.add(r["n_convs"], r["conv_id"])
            node.kids += r["kids"]
            node.leaves += r["leaves"]
            node.saved += r["saved"]
            out.append((r["block"], r["place"], node.at, *[None] * 7))
        if len(out) > 5000:
            yield _rows(out, schema)
            out.clear()
    while stack:
        close()
    yield _rows(out, schema)


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's ids, whose pieces come one after the other."""
    schema, node, state = _schema("node long, ids string"), None, None
    for batch in batches:
        out = []
        for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if now != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _rows(out, schema)
    if node is not None:
        yield _rows([(node, state.hexdigest())], schema)


def prefix_trie(convs: DataFrame, *, blocks: int | None = None) -> DataFrame:
    """The nodes of the trie of `convs` (conv long, unique; key binary of names of NAME bytes; words array<long>, one a turn).

    A node is a distinct sequence of first turns, the root that of none; conversations that start with it are its members, one
    without turns is a member of the root alone. Columns: conv_id (its smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, (n_convs - 1) times the
    words of the node's last turn), ends_sha256 (of the ids of members that end there, ascending, joined by commas). An empty
    table has no node.

    A conversation's key and the ids of one block's members fit in a task; the hash of a node's ids is one stream by its nature.
    """
    spark = convs.sparkSession
    held = saved(convs.select("conv", "key", "words"), "conversations")
    if blocks is None:
        turns = held.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    ordered = held.repartitionByRange(blocks, "key", "conv").sortWithinPartitions("key", "conv")
    swept = saved(ordered.select(F.spark_partition_id().alias("block"), "key", "conv", "words").mapInArrow(sweep, _SWEPT), "swept")

    parts = swept.where(f"kind = {OPEN}").repartition(1).sortWithinPartitions("block", "place")
    stitched = saved(parts.select("block", "place", "depth", "name", "words", "n_convs", "conv_id", "kids", "leaves", "saved").mapInArrow(stitch, _STITCHED), "stitched")
    whole = stitched.where("place is null").select("node", "parent", "depth", "n_convs", "conv_id", "kids", "leaves", "saved")
    named = stitched.where("place is not null").select("block", "place", "node")

    pieces = swept.where(f"kind = {IDS}").select("block", "place", F.col("parent").alias("piece"), "ids").join(named, ["block", "place"])
    hashed = pieces.repartition("node").sortWithinPartitions("node", "block", "piece").select("node", "ids").mapInArrow(_hash_ids, "node long, ids string")
    up = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.coalesce("ids", F.lit(NO_IDS)).alias("ends_sha256")
    rest = ["depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")]
    open_nodes = whole.join(up, "parent", "left").join(hashed, "node", "left").select("conv_id", *rest, ends)

    done = swept.where(f"kind = {DONE}")
    mothers = done.where("kids > 0").select("block", F.col("place").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    mothers = mothers.unionByName(named.join(whole, "node").select("block", F.col("place").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    return done.join(mothers, ["block", "parent"]).select("conv_id", *rest, F.col("ids").alias("ends_sha256")).unionByName(open_nodes)


GROUP, MOST_SHARED = 20, 4


def rebuilt(named: DataFrame) -> DataFrame:
    """Conversations of the query's fold: the first h turns of conversation c - c % GROUP, then c's own after its first h, where
    h is the CRC-32 of c in decimal modulo MOST_SHARED. One without any turn stays, with an empty key."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).alias("h")
    named = saved(named, "turns")
    ids = named.where("pos = 0").select("conv", h)
    own = named.withColumn("h", h).where("pos >= h").select("conv", (F.col("pos") + MOST_SHARED).alias("pos"), "name", "words")
    first = named.where(F.col("pos") < MOST_SHARED).withColumnRenamed("conv", "base")
    shared = ids.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(first, "base").where("pos < h").select("conv", "pos", "name", "words")
    none = ids.select("conv", *(F.lit(None).cast(t).alias(c) for c, t in (("pos", "long"), ("name", "string"), ("words", "long"))))
    t = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name", "words"))))
    d = own.unionByName(shared).unionByName(none).groupBy("conv").agg(t.alias("t"))
    return d.select("conv", F.unhex(F.array_join("t.name", "")).alias("key"), F.col("t.words").alias("words"))
