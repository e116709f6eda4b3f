"""Operator 12: prefix trie of rebuilt conversations, by burst tries.

A turn is the 128-bit digest of (role, text); a conversation is the string of its
digests.  Shards hold suffix containers under trie heads: at first a container per
first turn, and a container whose suffixes are more than ``CONTAINER`` turns bursts
by its next turns (1, 2, 4, ... of them at a time), until none is oversized.  What
remains is sorted by suffix and swept once: a stack of open nodes gives every node
below a head.  Heads are summed from their containers.  Members that end at a head
are a container of their own, which is streamed in order of conv_id.

Defined results: turns are ordered by turn (NULL first), ties by role and digest, so
repeated rows are turns of their own.  Rows with NULL conv_id take no part.  NULL
role and text are empty.  The leader of c is c - c % 5 with the sign of c kept by %.
Extra columns are not read.  An empty table has no nodes, not even a root.

Memory: a task holds the digests of one conversation (24 bytes a turn) and the nodes
of one container.  The digest over the members that end at one node is a sequential
hash, so such a list is one task's stream, 8 bytes a member, never a collected list.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove.sources.scratch import materialize

#: Turns of the suffixes of one container.
CONTAINER = 200_000
#: Bytes of a turn's digest.
WIDTH = 16
BATCH = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()


def head_turns(conv_id: int) -> int:
    """Number of turns that a conversation takes from its leader."""
    return zlib.crc32(str(conv_id).encode()) % 9


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of family, leader first, conversation and turn: one row per conversation."""
    out: list[tuple] = []
    family = conv = None
    leader_ids: list[bytes] = []
    leader_sizes: list[int] = []
    ids: list[bytes] = []
    sizes: list[int] = []

    def close() -> None:
        if conv is None:
            return
        if conv == family:
            leader_ids[:], leader_sizes[:] = ids[:8], sizes[:8]
        h = head_turns(conv)
        out.append((conv, b"".join(leader_ids[:h] + ids[h:]), leader_sizes[:h] + sizes[h:]))

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()),
                                 pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["conv_id", "ids", "sizes"])
        out.clear()
        return batch

    held = 0
    for batch in batches:
        for f, c, i, n in zip(*(batch.column(k).to_pylist() for k in ("family", "conv_id", "id", "size"))):
            if c != conv:
                close()
                held += len(ids)
                if f != family:
                    family = f
                    leader_ids.clear(), leader_sizes.clear()
                conv, ids, sizes = c, [], []
            ids.append(i)
            sizes.append(n)
        if held >= 16 * BATCH:
            held = 0
            yield flush()
    close()
    if out:
        yield flush()


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): digests and text bytes of every rebuilt conversation's turns."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        (F.col(conv) - F.col(conv) % 5).alias("family"), F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        who.alias("role"), F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))).alias("id"),
        F.octet_length(said).cast("long").alias("size"))
    ordered = rows.repartition("family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "role", "id")
    return ordered.select("family", "conv_id", "id", "size").mapInArrow(_rebuild, "conv_id long, ids binary, sizes array<long>")


def _left(path: Column | str, depth: Column) -> Column:
    return F.substring(path, F.lit(1), (depth * WIDTH).cast("int"))


def contained(convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """convs with ``path``, the head of each one's container, after oversized containers have burst."""
    n = (F.octet_length("ids") / WIDTH).cast("int")
    closed, depth, held = [], 1, convs
    while True:
        held = held.withColumn("path", _left("ids", F.least(n, F.lit(depth))))
        size = held.groupBy("path").agg(F.sum(F.greatest(n - depth, F.lit(0))).alias("size"))
        big = materialize(size.where(F.col("size") > container).select("path"), "burst")
        if big.isEmpty():
            return reduce(DataFrame.unionByName, closed, held)
        closed.append(held.join(big, "path", "left_anti"))
        held = held.join(big, "path", "left_semi").drop("path")
        depth *= 2


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "size", "below")

    def __init__(self, size: int):
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.size, self.below = None, size, []

    def end(self, conv: int) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(str(conv).encode())
            self.conv = conv if self.conv is None else min(conv, self.conv)
        else:
            self.ends.update(b",%d" % conv)
        self.n += 1


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_SWEPT = ", ".join(f"{c} long" for c in _NODE) + ", ends_sha256 string, path binary, sizes array<long>"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes below the heads, and one row per container's head with what lies below it.

    A node's row waits in its parent until the parent's least member is known.
    """
    out: list[tuple] = []
    path = ids = sizes = None
    stack: list[_Node] = []
    base = 0

    def pop() -> None:
        node, depth = stack.pop(), base + len(stack)
        over = stack[-1]
        node.leaves = node.leaves if node.children else 1
        node.saved += (node.n - 1) * node.size
        out.extend((c, depth + 1, node.conv, *rest) for c, *rest in node.below)
        over.below.append((node.conv, node.n, node.children, node.leaves, node.saved,
                           node.ends.hexdigest() if node.ends else NO_ENDS, None, None))
        over.conv = node.conv if over.conv is None else min(over.conv, node.conv)
        over.n += node.n
        over.children += 1
        over.leaves += node.leaves
        over.saved += node.saved

    def close() -> None:
        if path is None:
            return
        while len(stack) > 1:
            pop()
        top = stack.pop()
        out.extend((c, base + 1, top.conv, *rest) for c, *rest in top.below)
        out.append((top.conv, base, None, top.n, top.children, top.leaves, top.saved,
                    top.ends.hexdigest() if top.ends else None, path, sizes[:base]))

    def flush() -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.list_(pa.int64())]
        columns = list(zip(*out))
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=_NODE + ["ends_sha256", "path", "sizes"])
        out.clear()
        return batch

    for batch in batches:
        for p, c, i, s in zip(*(batch.column(k).to_pylist() for k in ("path", "conv_id", "ids", "sizes"))):
            if p != path:
                close()
                path, base, ids = p, len(p) // WIDTH, p
                stack = [_Node(s[base - 1] if base else 0)]
            if i != ids:
                same, most = base, min(len(ids), len(i)) // WIDTH
                while same < most and ids[same * WIDTH:(same + 1) * WIDTH] == i[same * WIDTH:(same + 1) * WIDTH]:
                    same += 1
                while base + len(stack) - 1 > same:
                    pop()
                stack.extend(_Node(x) for x in s[same:])
                ids = i
            sizes = s
            stack[-1].end(c)
            if len(out) >= BATCH:
                yield flush()
    close()
    if out:
        yield flush()


def trie_nodes(turns: DataFrame, container: int = CONTAINER, **columns: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    convs = materialize(rebuilt(turns, **columns), "conversations")
    ready = contained(convs, container).select("path", "conv_id", "ids", "sizes").repartition("path")
    swept = materialize(ready.sortWithinPartitions("path", "ids", "conv_id").mapInArrow(_sweep, _SWEPT), "swept")
    inner = swept.where(F.col("path").isNull()).drop("path", "sizes")

    # a head is the sum of the containers at and under it
    own = F.col("at") == F.col("depth")
    at = swept.where(F.col("path").isNotNull()).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth"))))
    heads = materialize(at.groupBy(_left("path", F.col("at")).alias("path")).agg(
        F.min("conv_id").alias("conv_id"), F.first("at").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.max(F.when(F.col("at") > 0, F.get("sizes", (F.col("at") - 1).cast("int")))).alias("size"),
        *[F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
        F.max(F.when(own, F.col("ends_sha256"))).alias("ends_sha256")), "heads")
    parent = _left("path", F.col("depth") - 1)
    below = heads.where("depth > 0").groupBy(parent.alias("path")).agg(F.count(F.lit(1)).alias("kids"))
    known = heads.join(below, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    adds = known.select(
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("depth")), lambda d: _left(F.col("path"), d))).alias("path"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))).alias("s"),
        (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("l"))
    sums = adds.groupBy("path").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    over = heads.select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    tops = known.join(sums, "path").join(over, (F.col("depth") > 0) & (parent == F.col("up")), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    return inner.unionByName(tops)
