"""Prefix trie of conversations, built as a burst trie in shards.

A turn is known by the first 16 bytes of a SHA-256 of its role and text, and a sequence of turns by a chain of such
digests, so no text travels beyond the first step. Equal sequences count once, with how many conversations say them.
A container holds the sequences below one trie head. It begins with all of them below the root; a container of more
than ``burst`` sequences bursts: the turns that all its sequences share are skipped at once, and each next turn id heads
a container of its own. What is left is dealt to tasks by head, sorted by head and sequence by Spark, and swept once: the
nodes of a container are a stack that follows the sorted sequences. Nodes on the way to a head, which several containers
share, are summed from one summary row per container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import SPACE_RUN, as_text, rows_of, written

#: Sequences that a container holds at most.
BURST = 256
_SIZE = 16
ROOT = hashlib.sha256(b"").digest()[:_SIZE]
_CHUNK_BYTES = 1 << 20
_ROWS = 4096


def _digest(c: Column) -> Column:
    return F.substring(F.unhex(F.sha2(c, 256)), 1, _SIZE)


def turn_lists(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turns``: each conversation's turns as ``id, words``, by turn (null first), ties by id.

    Null roles and texts read as empty; rows without a conversation id belong to none and are left out.
    A conversation is one row of 24 bytes a turn; its texts are not gathered.
    """
    said, who = as_text(F.col(text)), as_text(F.col(role))
    words = F.size(F.filter(F.split(said, SPACE_RUN, -1), lambda w: w != "")).cast("long")
    known = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.struct(
            F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"),
            _digest(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)).alias("id"), words.alias("words")).alias("one"))
    in_order = F.array_sort(F.collect_list("one"))
    return known.groupBy("conv").agg(in_order.alias("turns")).select(
        "conv", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def _chain(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(ROOT), lambda above, x: _digest(F.concat(above, x)))


def sequences(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (``end, ids, words, n, first``) and the conversations that say each (``end, conv``)."""
    said = lists.select("conv", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")).withColumn("end", _chain(F.col("ids")))
    said = written(said, "sequences")
    distinct = said.groupBy("end").agg(
        F.any_value("ids").alias("ids"), F.any_value("words").alias("words"), F.count("*").alias("n"), F.min("conv").alias("first"))
    return distinct, said.select("end", "conv")


def containers(distinct: DataFrame, burst: int = BURST) -> DataFrame:
    """``distinct`` with the ``head`` of each sequence's container and its ``depth``; none holds more than ``burst``.

    A round is a written table. Only containers that burst are looked at again.
    """
    if burst < 1:
        raise ValueError("a container holds one sequence at least")
    state = written(distinct.withColumns({"head": F.lit(ROOT), "depth": F.lit(0)}), "containers")
    done = None
    while True:
        each = state.groupBy("head").agg(F.count("*").alias("held"), F.min("ids").alias("low"), F.max("ids").alias("high"))
        same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
        large = each.where(F.col("held") > burst).select("head", (F.array_position(same, False).cast("int") - 1).alias("shared"))
        large = written(large, "large-containers")  # a row for each ``burst`` sequences at most
        left = state.join(large, "head", "left_anti")
        done = left if done is None else done.unionByName(left)
        if large.isEmpty():
            return done
        below = F.least(F.col("shared") + 1, F.size("ids"))
        moved = state.join(large, "head").withColumn("depth", below)
        state = written(moved.withColumn("head", _chain(F.slice("ids", 1, F.col("depth")))).drop("shared"), "containers")


_NODES = ("summary boolean, node binary, parent binary, depth int, first long, parent_first long, n long, children long, leaves long, saved long, "
          "path array<binary>, path_words array<long>")
_NODE_TYPES = [pa.bool_(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.list_(pa.binary()), pa.list_(pa.int64())]


class _Sweep:
    """Sorted sequences of one container after the other, as nodes; the last row of a container sums it up."""

    def __init__(self):
        self.head = None
        self.out: list[tuple] = []

    def add(self, head: bytes, depth: int, ids: list[bytes], words: list[int], n: int, first: int) -> None:
        if head != self.head:
            self.close()
            path = [ROOT]
            for x in ids[:depth]:
                path.append(hashlib.sha256(path[-1] + x).digest()[:_SIZE])
            self.head, self.depth, self.path, self.path_words = head, depth, path, [0, *words[:depth]]
            self.before, self.made = ids[:depth], []
            self.stack = [[head, first, 0, 0, 0, 0, 0, None]]  # node, first, n, children, leaves, saved, words, above
        before, size = self.before, min(len(ids), len(self.before))
        shared = depth
        while shared < size and ids[shared] == before[shared]:
            shared += 1
        self._pop(shared)
        for at in range(shared, len(ids)):
            above = self.stack[-1]
            self.stack.append([hashlib.sha256(above[0] + ids[at]).digest()[:_SIZE], first, 0, 0, 0, 0, words[at], above])
        self.stack[-1][2] += n
        self.stack[-1][1] = min(self.stack[-1][1], first)
        self.before = ids

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth - self.depth + 1:
            node = self.stack.pop()
            above = node[7]
            node[4] = node[4] or 1
            node[5] += (node[2] - 1) * node[6]
            above[1] = min(above[1], node[1])
            above[2] += node[2]
            above[3] += 1
            above[4] += node[4]
            above[5] += node[5]
            self.made.append((self.depth + len(self.stack), node))

    def close(self) -> None:
        if self.head is None:
            return
        self._pop(self.depth)
        root = self.stack[0]
        for depth, (node, first, n, children, leaves, saved, _, above) in self.made:
            self.out.append((False, node, above[0], depth, first, None if above is root else above[1], n, children, leaves, saved, None, None))
        self.out.append((True, self.head, None, self.depth, root[1], None, root[2], root[3], root[4], root[5], self.path, self.path_words))
        self.head = None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _NODES.split(", ")]
    sweep = _Sweep()

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        while sweep.out and len(sweep.out) >= least:
            part, sweep.out = sweep.out[:_ROWS], sweep.out[_ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _NODE_TYPES)], names)

    for batch in batches:
        for row in rows_of(batch):
            sweep.add(*row)
        yield from ready(_ROWS)
    sweep.close()
    yield from ready(1)


def trie_nodes(distinct: DataFrame, burst: int = BURST) -> DataFrame:
    """``node, first, depth, parent_first, n_convs, n_children, n_leaves, saved_tokens``: one row per node of the trie.

    ``node`` is the digest of the turns so far and ``first`` the smallest conversation below it. No sequences, no nodes.
    """
    held = containers(distinct, burst).select("head", "depth", "ids", "words", "n", "first")
    swept = written(held.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_sweep, _NODES), "trie-nodes")
    own = swept.where(~F.col("summary"))
    steps = F.transform("path", lambda x, i: F.struct(
        x.alias("node"), F.when(i > 0, F.get("path", i - 1)).alias("parent"), i.alias("depth"), F.get("path_words", i).alias("words"),
        F.when(i == F.col("depth"), F.col("children")).otherwise(0).alias("children"), F.slice("path", 1, i + 1).alias("way")))
    ways = swept.where("summary").select("first", "n", "leaves", "saved", F.explode(steps).alias("s")).groupBy("s.node").agg(
        F.any_value("s.parent").alias("parent"), F.any_value("s.depth").alias("depth"), F.any_value("s.words").alias("words"), F.any_value("s.way").alias("way"),
        F.min("first").alias("first"), F.sum("n").alias("n"), F.sum("s.children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ways = written(ways, "trie-heads")
    onward = ways.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    ways = ways.join(onward, "node", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    shares = ways.select(F.explode("way").alias("node"), ((F.col("n") - 1) * F.col("words")).alias("own_saved"), (F.col("children") == 0).cast("long").alias("own_leaf"))
    shares = shares.groupBy("node").agg(F.sum("own_saved").alias("own_saved"), F.sum("own_leaf").alias("own_leaf"))
    ways = ways.join(shares, "node").select("node", "parent", "depth", "first", F.lit(None).cast("long").alias("parent_first"), "n", "children",
                                            (F.col("leaves") + F.col("own_leaf")).alias("leaves"), (F.col("saved") + F.col("own_saved")).alias("saved"))
    ways = written(ways, "trie-heads")
    both = ways.unionByName(own.select(*ways.columns))
    above = ways.select(F.col("node").alias("above"), F.col("first").alias("above_first"))
    linked = both.withColumn("up", F.when(F.col("parent_first").isNull(), F.col("parent"))).join(above, F.col("up") == F.col("above"), "left")
    return linked.select("node", "first", "depth", F.coalesce("parent_first", "above_first").alias("parent_first"), F.col("n").alias("n_convs"),
                         F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """``end, sha256``: digest of the comma-joined decimal ids of the conversations that end there, ascending.

    Rows are sorted by range, so an end that a third of all conversations share is spread; only joined pieces of
    some MB meet again, in order, in the task that chains their hash.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, ids, size = None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([open_], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["end", "first", "ids"])

        for batch in batches:
            for end, conv in rows_of(batch):
                if ids and (end != open_ or size > _CHUNK_BYTES):
                    yield piece()
                    ids, size = [], 0
                open_ = end
                ids.append(conv)
                size += 20
        if ids:
            yield piece()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([open_], pa.binary()), pa.array([hashed.hexdigest()], pa.string())], ["end", "sha256"])

        open_, hashed = None, None
        for batch in batches:
            for end, _, ids in rows_of(batch):
                if hashed is not None and end == open_:
                    hashed.update(b",")
                else:
                    if hashed is not None:
                        yield row()
                    open_, hashed = end, hashlib.sha256()
                hashed.update(ids.encode())
        if hashed is not None:
            yield row()

    pieces = ends.repartitionByRange("end", "conv").sortWithinPartitions("end", "conv").mapInArrow(joined, "end binary, first long, ids string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(chained, "end binary, sha256 string")


def conversation_trie(lists: DataFrame, burst: int = BURST) -> DataFrame:
    """``trie_nodes`` of conversations given as turn lists, with ``ends_sha256`` of those that end at each node.

    Repeated turns are turns; conversations without any end at the root; an empty table has no nodes.
    """
    distinct, ends = sequences(lists)
    nodes, ended = trie_nodes(distinct, burst), ends_digests(ends)
    return nodes.join(ended, nodes["node"] == ended["end"], "left").drop("end", "node").withColumn(
        "ends_sha256", F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("sha256")
