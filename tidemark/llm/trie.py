"""Prefix trie of conversations by time-forward processing.

A node of depth d is a distinct sequence of the first d (role, text) turns of some conversation; the root
has depth 0.  A node is known by its smallest member and its depth.  Totals over subtrees (leaves, saved
bytes) travel upwards as messages:

1. Turns are numbered by a range shuffle, and a prefix is identified by 128 bits: four running sums of
   hashes of (place, role, text), which the bucketed running totals of ``SeriesFrame`` give, so that neither
   a long conversation nor a prefix that a third of all conversations share is one task.
2. A node is heavy if the conversations below it have more than ``shard_rows`` turns left (and more than
   1/4096 of all turns).  The subtree of the shallowest light node on a path is a shard.
3. Within shards: nodes are sorted externally in reverse level order, deepest first.  A sweep adds to each
   node the messages that wait for it and sends its totals to its parent through a priority queue, which
   combines messages of one parent and spills sorted runs to scratch space of the task.
4. Across shard roots: their totals, combined per parent, enter the heavy nodes, of which a level has 4096
   at most.  These are swept the same way, in blocks of ``levels`` levels, the deepest block first.

Defined results: turns are ordered by turn, NULL first, then by role and text; repeated rows are turns of
their own.  A NULL role or text is empty.  Rows without a conversation id belong to no conversation.  An
empty table has no node.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import SeriesFrame, number_rows
from tidemark.llm.common import keep

#: Turns below a node from which on it is heavy.
SHARD_ROWS = 50_000
#: At most so many heavy nodes on one level.
SHARDS = 4096
#: Levels of heavy nodes that one sweep covers.
LEVELS = 1 << 16
#: Messages that a queue holds in memory.
QUEUE_ROWS = 1 << 20
#: Conversations of one family share turns of its first; the number of shared turns is below HEADS.
FAMILY, HEADS = 5, 9


# -- rebuilt conversations ---------------------------------------------------------------------


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, bytes, len) of every turn and (conv, len) of every rebuilt conversation.

    Conversation c gets the first h turns of conversation c - c % 5 and then its own after its first h.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    turns = number_rows(rows, ["conv"], ["turn", "role", "text"]).df.select(
        "conv", "pos", F.unhex(F.sha2(turn.cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    turns = keep(turns, "turns")
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = lengths.select(
        "conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("source"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"))
    convs = convs.join(lengths.select(F.col("conv").alias("source"), F.col("n").alias("given")), "source", "left")
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = keep(convs.select("conv", "source", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    own = turns.join(convs, "conv").where("pos >= h").withColumn("depth", F.col("k") + F.col("pos") - F.col("h") + 1)
    heads = turns.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv", "source").join(convs, "source").where("pos < h")
    columns = ["conv", "depth", "digest", "bytes", "len"]
    return own.select(*columns).union(heads.withColumn("depth", F.col("pos") + 1).select(*columns)), convs.select("conv", "len")


# -- nodes -------------------------------------------------------------------------------------


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(salt), depth, *sums) for salt in (1, 2)]


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, bytes, len): the node that each turn leads to, and the one it comes from."""
    hashed = turns.withColumns({f"h{s}": F.xxhash64(F.lit(s), "depth", "digest") for s in (1, 2)})
    parts = {}
    for s in (1, 2):
        parts |= {f"t{s}a": F.col(f"h{s}").bitwiseAND(F.lit(0xFFFFFFFF)), f"t{s}b": F.shiftrightunsigned(f"h{s}", 32)}
    rows = hashed.select("conv", "depth", "bytes", "len", (F.col("depth") - 1).alias("pos"), *[c.alias(n) for n, c in parts.items()])
    rows = SeriesFrame(rows, ("conv",)).running({f"s_{n}": F.col(n) for n in parts}).df
    own = _key(F.col("depth"), [F.col(f"s_{n}") for n in parts])
    before = _key(F.col("depth") - 1, [F.col(f"s_{n}") - F.col(n) for n in parts])
    return rows.select("conv", "depth", own[0].alias("k1"), own[1].alias("k2"), before[0].alias("p1"), before[1].alias("p2"), "bytes", "len")


def nodes(path_rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node with its members, children, parent, own totals and the turns left below it."""
    zero = _key(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    inner = path_rows.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n"), F.min("bytes").alias("bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.sum(F.col("len") + 1).alias("weight")).where("n > 0")
    none = F.lit(None).cast("long")
    root = root.select(zero[0].alias("k1"), zero[1].alias("k2"), "conv", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("bytes"),
                       none.alias("p1"), none.alias("p2"), "weight")
    every = keep(inner.union(root), "nodes")
    children = every.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = every.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    every = every.join(children, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    return every.select("k1", "k2", "conv", "depth", "parent", "n", n_children.alias("n_children"), (n_children == 0).cast("long").alias("leaves"),
                        ((F.col("n") - 1) * F.col("bytes")).alias("saved"), "weight")


# -- time-forward processing -------------------------------------------------------------------


def _combined(conv: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages in order of their receiver, one for each."""
    order = np.argsort(conv, kind="stable")
    conv, totals = conv[order], totals[order]
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if len(conv) else np.zeros(0, np.int64)
    return conv[first], np.add.reduceat(totals, first, axis=0) if len(first) else totals


class _Run:
    """Sorted messages, read from the front; in memory, or in scratch space and then a block at a time."""

    def __init__(self, conv: np.ndarray, totals: np.ndarray, spilled: bool, block: int):
        self.conv, self.totals, self.at, self.file, self.left, self.block = conv, totals, 0, None, 0, block
        if spilled:
            # only this task reads it, and it is gone with the task, like the spills of a sort
            self.file, self.left = tempfile.TemporaryFile(), len(conv)
            np.column_stack([conv, totals]).astype(np.int64).tofile(self.file)
            self.file.seek(0)
            self.conv, self.totals = conv[:0], totals[:0]

    def upto(self, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while True:
            end = int(np.searchsorted(self.conv, last, "right"))
            yield self.conv[self.at : end], self.totals[self.at : end]
            self.at = end
            if end < len(self.conv) or not self.left:
                return
            rows = np.fromfile(self.file, np.int64, 3 * min(self.left, self.block)).reshape(-1, 3)
            self.left -= len(rows)
            self.conv, self.totals, self.at = rows[:, 0].copy(), rows[:, 1:].copy(), 0


class MessageQueue:
    """Messages to the nodes of one level, taken out in order of the receiver."""

    def __init__(self, most: int = QUEUE_ROWS):
        self.most, self.fresh, self.rows, self.runs, self.spills = most, [], 0, [], 0

    def push(self, conv: np.ndarray, totals: np.ndarray) -> None:
        if len(conv):
            self.fresh.append(_combined(conv, totals))
            self.rows += len(self.fresh[-1][0])
        if self.rows > self.most:
            conv, totals = _combined(*map(np.concatenate, zip(*self.fresh)))
            self.fresh, self.rows = [(conv, totals)], len(conv)
            if 2 * self.rows > self.most:
                self._close(True)

    def _close(self, spilled: bool) -> None:
        if self.fresh:
            self.runs.append(_Run(*_combined(*map(np.concatenate, zip(*self.fresh))), spilled, max(1, self.most // 16)))
            self.spills += spilled
        self.fresh, self.rows = [], 0

    def pop(self, last: int) -> tuple[np.ndarray, np.ndarray]:
        """All messages to receivers up to ``last``."""
        self._close(False)
        parts = [p for run in self.runs for p in run.upto(last)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def sweep(batches: Iterator[pa.RecordBatch], queue_rows: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Totals over subtrees of the nodes of a partition, which come deepest level first and by conv within a level.

    Messages go one level up, so two queues are alive: of the level that is swept and of the next.
    A node marked ``top`` keeps its message.
    """
    level, here, above = None, MessageQueue(queue_rows), MessageQueue(queue_rows)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth, top = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv", "depth", "top"))
        parent = pc.fill_null(batch.column("parent"), 0).to_numpy(zero_copy_only=False)
        totals = np.column_stack([batch.column("leaves").to_numpy(), batch.column("saved").to_numpy()])
        cuts = np.r_[0, np.flatnonzero(np.diff(depth)) + 1, len(depth)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if depth[a] != level:
                here = above if level is not None and depth[a] == level - 1 else MessageQueue(queue_rows)
                above, level = MessageQueue(queue_rows), depth[a]
            to, sent = here.pop(conv[b - 1])
            np.add.at(totals, a + np.searchsorted(conv[a:b], to), sent)
            up = a + np.flatnonzero(~top[a:b])
            above.push(parent[up], totals[up])
        for name, k in (("leaves", 0), ("saved", 1)):
            batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(totals[:, k].copy()))
        yield batch


_SWEPT = ["k1", "k2", "conv", "depth", "parent", "n", "n_children", "leaves", "saved", "top"]


def _swept(placed: DataFrame, queue_rows: int) -> DataFrame:
    ordered = placed.sortWithinPartitions(F.col("depth").desc(), "conv").select(*_SWEPT)
    return ordered.mapInArrow(lambda batches: sweep(batches, queue_rows), ordered.schema)


def _received(rows: DataFrame, shard_roots: DataFrame) -> DataFrame:
    """Nodes with the combined totals of the shard roots below them."""
    sent = shard_roots.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    rows = rows.join(sent, ["conv", "depth"], "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})


def subtree_totals(every: DataFrame, path_rows: DataFrame, shard_rows: int = SHARD_ROWS, levels: int = LEVELS,
                   queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """The nodes with ``leaves`` and ``saved`` summed over their subtrees."""
    turns = every.where("depth = 0").select("weight").first()
    limit = max(shard_rows, turns[0] // SHARDS if turns else 0)
    heavy = keep(every.where((F.col("depth") == 0) | (F.col("weight") > limit)), "heavy")
    top = path_rows.join(heavy.select("k1", "k2"), ["k1", "k2"], "left_anti").groupBy("conv").agg(F.min(F.struct("depth", "k1", "k2")).alias("shard"))
    light = every.join(heavy.select("k1", "k2"), ["k1", "k2"], "left_anti").join(top, "conv")
    light = light.withColumn("top", F.col("depth") == F.col("shard.depth")).repartition(F.col("shard.k1"), F.col("shard.k2"))
    done = keep(_swept(light, queue_rows), "light")
    heavy, roots = _received(heavy, done.where("top")), None
    deepest = heavy.agg(F.max("depth")).first()[0]
    for block in range((deepest or 0) // levels, -1, -1):
        rows = heavy.where(F.floor(F.col("depth") / levels) == block)
        rows = _received(rows.drop("more_leaves", "more_saved"), roots) if roots is not None else rows
        rows = keep(_swept(rows.withColumn("top", F.col("depth") % levels == 0).repartition(1), queue_rows), "heavy")
        done, roots = done.union(rows), rows.where("top")
    return done


# -- who ends where ----------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in sorted rows become one row with their ids in decimal, joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        first = np.r_[0, np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1]
        ids = pa.ListArray.from_arrays(pa.array(np.r_[first, len(k1)], pa.int32()), batch.column("conv").cast(pa.string()))
        joined = pc.binary_join(ids, ",")
        yield pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), batch.column("conv").take(pa.array(first)), joined], ["k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node in turn; of a node only the state of its hash is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["k1", "k2", "ends_sha256"])


def ends(path_rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end.

    The ids of a node are joined to chunks where the sorted rows lie; one task reads the chunks of a node in
    order, as its hash asks for, and holds nothing of them.
    """
    zero = _key(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    at = path_rows.where("depth = len").select("k1", "k2", "conv").union(convs.where("len = 0").select(*zero, "conv"))
    runs = keep(at, "ends").repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    chunks = runs.mapInArrow(_chunks, "k1 long, k2 long, first long, ids string")
    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, levels: int = LEVELS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuild(conversations)
    path_rows = keep(paths(turns), "paths")
    every = keep(nodes(path_rows, convs), "trie")
    done = subtree_totals(every, path_rows, shard_rows, levels, queue_rows)
    done = done.join(ends(path_rows, convs), ["k1", "k2"], "left")
    return done.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
