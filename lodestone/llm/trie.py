"""Conversation prefix trie: a global range sort, adjacent common prefixes, one stack sweep a partition, stitched.

Conversations are rows of turn arrays. Sorted by (turns, conv_id), those that share a prefix are neighbours, so a
node (a distinct prefix) is a run of rows whose adjacent longest common prefixes (LCPs) reach its depth. Each
partition sweeps its rows once with a stack of open nodes. Nodes that may go on beyond an end of a partition are
written as parts and summed by a digest of their prefix, however many partitions they span; what a partition can't
know, the LCP with the last row before it, follows from the first and last rows of neighbours and is added as rows
of its own. No group, stack or list of members passes through the driver, which learns the numbers of the tasks.

Turns are compared by SHA-256 of role and text (the length of the role first), so rows stay small however long the
texts are: a conversation is one row of 40 bytes a turn.

Cases: null roles and texts are empty; a null turn number comes first; turns with the same number are ordered by
role, then digest; rows without a conv_id take no part; rows of ``prefix_trie`` with one conv_id are members each;
an empty table has no nodes, turnless conversations the root alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import store

#: Members' ids in one row of an open node.
CHUNK = 65_536

SWEPT = pa.schema(
    [
        ("kind", pa.string()),
        ("task", pa.int32()),
        *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        ("ends_sha256", pa.string()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("at", pa.int64()),
        ("ids", pa.string()),
        ("path", pa.list_(pa.binary())),
    ]
)
_DDL = "kind string, task int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, at long, ids string, path array<binary>"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_key(role: Column, text: Column) -> Column:
    """40 bytes: SHA-256 of role and text, then the text's length in bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")))


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations(conv_id, turn, role, text), one row a conv_id."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), turn_key(F.col("role"), F.col("text")).alias("key"))
    rows = conversations.where("conv_id is not null").select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return rows.select("conv_id", F.col("ts.key").alias("turns"))


def _bytes(key: bytes) -> int:
    return int.from_bytes(key[32:], "big")


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _prefixes(path: list[bytes]) -> list[bytes]:
    """A digest of each prefix of a path, the empty one first."""
    out = [hashlib.sha256(b"").digest()]
    for key in path:
        out.append(hashlib.sha256(out[-1] + key).digest())
    return out


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@dataclass(slots=True)
class _Node:
    depth: int
    whole: bool  # begins in this task, so only the end of the task can leave it open
    conv_id: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)  # closed children, which need this node's smallest member


class _Sweep:
    """The open nodes of one task, from the root to the last row's end, and the rows they leave behind."""

    def __init__(self, task: int, first: list[bytes]):
        self.task, self.path, self.keys = task, first, _prefixes(first)
        self.stack = [_Node(d, False) for d in range(len(first) + 1)]
        for d in range(len(first)):
            self.stack[d].children = 1
        self.out = [{"kind": "first", "task": task, "path": first}]

    def row(self, conv_id: int, turns: list[bytes]) -> None:
        shared = _common(self.path, turns)
        while len(self.stack) > shared + 1:
            self.close(self.stack.pop())
        if len(turns) > shared:
            del self.keys[shared + 1 :]
            self.path = turns
            for d in range(shared + 1, len(turns) + 1):
                self.stack[d - 1].children += 1
                self.stack.append(_Node(d, True))
        top = self.stack[-1]
        top.ends.append(conv_id)
        top.n += 1
        top.conv_id = conv_id if top.conv_id is None else min(top.conv_id, conv_id)

    def key(self, depth: int) -> bytes:
        """Digest of the current path's prefix, made when first asked for."""
        while len(self.keys) <= depth:
            self.keys.append(hashlib.sha256(self.keys[-1] + self.path[len(self.keys) - 1]).digest())
        return self.keys[depth]

    def close(self, node: _Node, at_end: bool = False) -> None:
        """Add a node to its parent (the top of the stack now) and write it, or its part."""
        if node.depth:
            node.saved += (node.n - 1) * _bytes(self.path[node.depth - 1])
        if not node.children:
            node.leaves = 1
        row = {"task": self.task, "depth": node.depth, "conv_id": node.conv_id, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if node.depth:
            parent = self.stack[node.depth - 1]
            parent.n += node.n
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.conv_id = node.conv_id if parent.conv_id is None else min(parent.conv_id, node.conv_id)
        if at_end or not node.whole:
            mine = self.key(node.depth)
            self.out.append({**row, "kind": "open", "node": mine, "parent": self.key(node.depth - 1) if node.depth else None})
            for at in range(0, len(node.ends), CHUNK):
                self.out.append({"kind": "ends", "task": self.task, "node": mine, "at": at, "ids": ",".join(map(str, node.ends[at : at + CHUNK]))})
            for child in node.waiting:
                self.out.append({**child, "kind": "below", "parent": mine})
            return
        for child in node.waiting:
            self.out.append({**child, "kind": "whole", "parent_conv_id": node.conv_id})
        row["ends_sha256"] = _digest(node.ends)
        if parent.whole:
            parent.waiting.append(row)
        else:
            self.out.append({**row, "kind": "below", "parent": self.key(parent.depth)})

    def finish(self) -> None:
        self.out.append({"kind": "last", "task": self.task, "path": self.path[: len(self.stack) - 1]})
        while self.stack:
            self.close(self.stack.pop(), at_end=True)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = None
    for batch in batches:
        ids, turns = batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()
        for conv_id, path in zip(ids, turns, strict=True):
            if sweep is None:
                sweep = _Sweep(batch.column("task")[0].as_py(), path)
            sweep.row(conv_id, path)
            if len(sweep.out) >= 4096:
                yield pa.RecordBatch.from_pylist(sweep.out, SWEPT)
                sweep.out = []
    if sweep is not None:
        sweep.finish()
        yield pa.RecordBatch.from_pylist(sweep.out, SWEPT)


def _stitches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the LCP across each boundary changes: a shared node is no further child, its first row there repeats
    its turns, and an end that goes on is no leaf of its own."""
    for batch in batches:
        out = []
        for before, after in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True):
            shared = _common(before, after)
            keys, saved = _prefixes(after[:shared]), 0
            for d in range(shared, -1, -1):
                saved += _bytes(after[d - 1]) if d else 0
                out.append({"node": keys[d], "parent": keys[d - 1] if d else None, "depth": d, "n_convs": 0, "n_children": -(d < shared), "n_leaves": -(shared == len(before)), "saved_tokens": saved})
        yield pa.RecordBatch.from_pylist(out, pa.schema([SWEPT.field(c) for c in _PART]))


_PART = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of each node's ids; rows come sorted by node and place, so the ids are streamed, not held."""
    node, held = None, None
    for batch in batches:
        done = []
        for mine, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if mine == node:
                held.update(b",")
            else:
                if node is not None:
                    done.append((node, held.hexdigest()))
                node, held = mine, hashlib.sha256()
            held.update(ids.encode())
        yield pa.record_batch([pa.array([n for n, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([held.hexdigest()], pa.string())], ["node", "ends_sha256"])


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """Nodes of the trie of arrays(conv_id, turns of ``turn_key``): the columns NODE, one row a distinct prefix."""
    order = ["turns", "conv_id"]
    dealt = arrays.select("conv_id", F.coalesce("turns", F.array().cast("array<binary>")).alias("turns")).repartitionByRange(*order).sortWithinPartitions(*order)
    swept = store.written(dealt.withColumn("task", F.spark_partition_id()).mapInArrow(_swept, _DDL), "trie-sweep")
    spark = swept.sparkSession
    # one number a task of the sort: tasks without rows are no neighbours
    tasks = sorted(r.task for r in swept.where("kind = 'first'").select("task").collect())
    pairs = spark.createDataFrame(list(zip(tasks, tasks[1:], strict=False)), "task int, next int")
    last = swept.where("kind = 'last'").select("task", F.col("path").alias("before"))
    first = swept.where("kind = 'first'").select(F.col("task").alias("next"), F.col("path").alias("after"))
    stitches = pairs.join(last, "task").join(first, "next").mapInArrow(_stitches, ", ".join(f"{c} {'binary' if c in ('node', 'parent') else 'long'}" for c in _PART))
    parts = swept.where("kind = 'open'")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    opened = store.written(parts.select(_PART).unionByName(stitches).groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums), "trie-open")
    ends = swept.where("kind = 'ends'").select("node", "task", "at", "ids").repartition("node").sortWithinPartitions("node", "task", "at").select("node", "ids").mapInArrow(_end_digests, "node binary, ends_sha256 string")
    above = opened.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    stitched = opened.join(above, "parent", "left").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_digest([]))))
    # each task has its own copies of its open nodes, so no parent gathers children from all tasks
    own = parts.select("task", F.col("node").alias("parent")).join(above, "parent")
    below = swept.where("kind = 'below'").drop("parent_conv_id").join(own, ["task", "parent"])
    out = swept.where("kind = 'whole'").select(NODE).unionByName(below.select(NODE)).unionByName(stitched.select(NODE))
    done = store.written(out, "trie")
    store.drop(swept)
    store.drop(opened)
    return done


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes of a trie of conversations(conv_id, turn, role, text) with the role and text of their last turn (root: null)."""
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    key = turn_key(F.col("role"), F.col("text"))
    rows = conversations.where("conv_id is not null").select("conv_id", *plain, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), key.alias("key")).alias("t"))
    # by conversation the turns of a node's smallest member; equal turns are equal texts
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("t")).cast("long")
    return nodes.join(rows.select("conv_id", place.alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
