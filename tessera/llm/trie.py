"""Operator 12: the trie of conversation prefixes, with subtree totals by time-forward processing.

Conversations are sequences of (role, text) turns.  Each distinct sequence of
the first d turns is a node; the conversations that start with it are its
members; node totals (leaves, tokens saved by storing a shared turn once) go
up from children to parents.

Nodes are told by depth and two 64-bit running sums of turn digests (a turn's
digest depends on its text, role and depth), so a node's parent has the sums
less the node's own digest, and a conversation of any length is summed up in
blocks: no conversation is ever gathered.

Runs.  Consecutive nodes with one smallest member and the same number of
members form a run: each but the lowest has exactly one child and no
conversation ends in it.  Inside a run, totals follow from running sums of
text lengths, so only runs pass totals on: at most two per conversation,
however long it is.

Shards.  A run has level j if its member count lies in (fan**j, fan**(j+1)].
Connected runs of one level are a shard, named by the smallest member of
its topmost node, so a shard of level 0 has at most 2 * fan runs.  Levels are
done from below.  Inside a shard the runs come sorted by reverse level order
(Spark's external sort); each takes its children's totals from a priority
queue, adds its own and sends the sum to its parent through the queue, which
spills sorted runs to task-local scratch files beyond a bound.  A shard's top
run sends to a higher level; these messages are summed per receiver before
the next level begins, up to the root.

Ends.  The ids of the conversations that end in a node are sorted, joined in
pieces of a few kilobytes, and hashed piece by piece, never held together.

Edge cases: rows with a null conversation id take no part; null role or text
is empty; a null turn comes first; rows with one turn number go by the
SHA-256 of role and text, so repeated rows are turns of their own; an empty
table gives no rows; a conversation without turns is a member of the root
only; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import rank_within
from ..operators.scan import prefix_sums
from .store import partitions, stored

FAN = 4096
QUEUE = 1 << 18  # messages a queue holds in memory
PIECE = 8192  # bytes of joined ids
HEADS, GROUP = 5, 100  # a conversation begins with at most so many turns of the first of its group
KEY = ["d", "a", "b"]


def turns_in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, r, digest, len): turns numbered from 1 within their conversation; no text is shuffled."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                         text("role").alias("role"), text("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    t = t.select("conv_id", "turn", digest.alias("digest"), F.length("text").cast("long").alias("len"), F.monotonically_increasing_id().alias("row"))
    return rank_within(t, ["conv_id"], ["turn", "digest", "row"], "r").select("conv_id", "r", "digest", "len")


def _hashes(d: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), F.col(d), F.col("digest")), F.xxhash64(F.lit(2), F.col(d), F.col("digest"))


def rebuilt(turns: DataFrame, heads: int = HEADS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) of the conversations that begin with turns of the first of their group.

    rows: (conv_id, d, a, b, c, len, pa, pb, ends), one per rebuilt turn: key of its node and of the parent, code points up to
    it, and whether the conversation ends there.  conversations: (conv_id, size).
    """
    own = stored(turns_in_order(turns), "turns-in-order")
    x, y = _hashes("r")
    w = Window.partitionBy("conv_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)  # at most ``heads`` rows
    first = own.where((F.col("r") <= heads) & (F.col("conv_id") % group == 0)).select("conv_id", "r", "len", x.alias("x"), y.alias("y"))
    first = first.select("conv_id", F.struct(F.col("r").alias("d"), F.sum("x").over(w).alias("a"), F.sum("y").over(w).alias("b"),
                                             F.sum("len").over(w).alias("c"), "len", "x", "y").alias("t"))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list("t")).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (heads + 1)).alias("h")
    convs = own.groupBy("conv_id").agg(F.max("r").alias("n_own")).select("conv_id", "n_own", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = convs.join(first, "base", "left").withColumn("head", F.slice("head", F.lit(1), F.col("h").cast("int"))) \
        .withColumn("k", F.coalesce(F.when(F.col("head").isNotNull(), F.size("head")), F.lit(0)).cast("long"))
    last = F.when(F.col("k") > 0, F.element_at("head", F.col("k").cast("int")))
    zero = lambda c: F.coalesce(last[c], F.lit(0).cast("long")).alias(f"{c}0")
    convs = stored(convs.select("conv_id", "n_own", "h", "k", "head", zero("a"), zero("b"), zero("c"),
                                (F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    rest = own.join(convs.select("conv_id", "n_own", "h", "k", "a0", "b0", "c0"), "conv_id").where("r > h") \
        .withColumn("d", F.col("r") - F.col("h") + F.col("k"))
    x, y = _hashes("d")
    rest = rest.select("conv_id", "d", "len", x.alias("x"), y.alias("y"), "a0", "b0", "c0", (F.col("r") == F.col("n_own")).alias("ends"))
    rest = prefix_sums(rest, ["conv_id"], "d", {"sa": F.col("x"), "sb": F.col("y"), "sc": F.col("len")})
    rest = rest.select("conv_id", "d", (F.col("sa") + F.col("a0")).alias("a"), (F.col("sb") + F.col("b0")).alias("b"), (F.col("sc") + F.col("c0")).alias("c"),
                       "len", "x", "y", "ends")
    begun = convs.select("conv_id", "n_own", "h", "k", F.explode("head").alias("t")) \
        .select("conv_id", "t.d", "t.a", "t.b", "t.c", "t.len", "t.x", "t.y", ((F.col("n_own") <= F.col("h")) & (F.col("t.d") == F.col("k"))).alias("ends"))
    rows = rest.unionByName(begun).select("conv_id", *KEY, "c", "len", (F.col("a") - F.col("x")).alias("pa"), (F.col("b") - F.col("y")).alias("pb"), "ends")
    return stored(rows, "rebuilt-turns"), convs.select("conv_id", "size")


class SpillingQueue:
    """Smallest first; holds at most ``bound`` messages in memory, the rest in sorted runs on task-local scratch files."""

    _MESSAGE = struct.Struct("<5q")

    def __init__(self, bound: int = QUEUE):
        self.bound, self.heap, self.spilled, self.heads = bound, [], [], []

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        if len(self.heap) >= self.bound:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # has no name and goes with the task
        for m in sorted(self.heap):
            file.write(self._MESSAGE.pack(*m))
        file.seek(0)
        self.heap = []
        self.spilled.append(file)
        self._advance(len(self.spilled) - 1)

    def _advance(self, run: int) -> None:
        raw = self.spilled[run].read(self._MESSAGE.size)
        if raw:
            heapq.heappush(self.heads, (self._MESSAGE.unpack(raw), run))
        else:
            self.spilled[run].close()

    def peek(self):
        a = self.heap[0] if self.heap else None
        b = self.heads[0][0] if self.heads else None
        return b if a is None else a if b is None else min(a, b)

    def pop(self):
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            message, run = heapq.heappop(self.heads)
            self._advance(run)
            return message
        return heapq.heappop(self.heap)


def _time_forward(bound: int):
    """Totals of the runs of whole shards; rows come by shard and falling lowest depth."""
    names = ["conv_id", "n", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue(bound)
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for s, bottom, conv, n, top, p_conv, p_n, inside, own, leaves, saved in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    if queue.peek() is not None:
                        raise RuntimeError("a message was left over: its receiver is in no shard")
                    shard = s
                at = (-bottom, conv, n)
                while (m := queue.peek()) is not None and m[:3] == at:
                    queue.pop()
                    leaves, saved = leaves + m[3], saved + m[4]
                leaves, saved = leaves or 1, saved + own
                if inside:
                    queue.push((1 - top, p_conv, p_n, leaves, saved))  # the parent's lowest node is just above this run's highest
                out.append((conv, n, leaves, saved))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
    return run


def _level(n: str, fan: int, levels: int) -> Column:
    """j with fan**j < n <= fan**(j + 1), 0 at least."""
    return sum(((F.col(n) > F.lit(fan ** j)).cast("int") for j in range(1, levels)), F.lit(0))


def subtree_totals(rows: DataFrame, convs: DataFrame, tree: DataFrame, fan: int = FAN, queue: int = QUEUE) -> DataFrame:
    """(conv_id, n, low_c, leaves, below) of every run: leaves below it, and tokens saved below its lowest node."""
    spark = rows.sparkSession
    root = tree.where("d = 0").first()  # one row, none for an empty table
    least, most = (root["conv_id"], root["n"]) if root else (0, 1)
    levels = 1
    while fan ** levels < most:
        levels += 1
    runs = tree.groupBy("conv_id", "n").agg(
        F.min("d").alias("top"), F.max("d").alias("bottom"), F.max("c").alias("low_c"), F.min(F.col("c") - F.col("len")).alias("c_before"),
        F.min_by("p_conv", "d").alias("p_conv"), F.min_by("p_n", "d").alias("p_n"))
    runs = runs.withColumn("own", (F.col("n") - 1) * (F.col("low_c") - F.col("c_before"))).withColumn("level", _level("n", fan, levels))
    if levels == 1:
        runs = runs.withColumn("shard", F.lit(0).cast("long"))
    else:  # the smallest member of the topmost node of the same level above a run
        node = tree.select(*KEY, F.col("conv_id").alias("owner"), _level("n", fan, levels).alias("level"))
        path = rows.select("conv_id", *KEY).join(node, KEY).select("conv_id", "d", "owner", "level")
        path = path.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(least).cast("long").alias("owner"), F.lit(levels - 1).alias("level")))
        top = path.groupBy("conv_id", "level").agg(F.min_by("owner", "d").alias("shard"))
        runs = runs.join(top, ["conv_id", "level"])
    runs = stored(runs, "trie-runs")
    done: list[DataFrame] = []
    run = _time_forward(queue)
    for j in range(levels):
        mine = runs.where(F.col("level") == j)
        for k, below in enumerate(done):  # what shard tops of lower levels send to runs of this one
            up = below.join(runs.where(F.col("level") == k).select("conv_id", "n", "p_conv", "p_n"), ["conv_id", "n"]) \
                .where(F.col("p_conv").isNotNull() & (_level("p_n", fan, levels) == j)) \
                .groupBy(F.col("p_conv").alias("conv_id"), F.col("p_n").alias("n")).agg(F.sum("leaves").alias(f"l{k}"), F.sum("saved").alias(f"s{k}"))
            mine = mine.join(up, ["conv_id", "n"], "left")
        total = lambda c: sum((F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for k in range(j)), F.lit(0)).cast("long")
        inside = F.coalesce(_level("p_n", fan, levels) == j, F.lit(False)) & F.col("p_conv").isNotNull()
        mine = mine.select("shard", "bottom", "conv_id", "n", "top", "p_conv", "p_n", inside.alias("inside"), "own", total("l").alias("l"), total("s").alias("s"))
        mine = mine.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.desc("bottom"), "conv_id", "n")
        done.append(stored(mine.mapInArrow(run, "conv_id long, n long, leaves long, saved long"), f"totals-{j}"))
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    return totals.join(runs.select("conv_id", "n", "low_c", "own"), ["conv_id", "n"]) \
        .select("conv_id", "n", "low_c", "leaves", (F.col("saved") - F.col("own")).alias("below"))


def id_digests(ends: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(by, ends_sha256): SHA-256 of the rising decimal ids of every group, comma-joined; no group is held."""
    spark = ends.sparkSession
    kinds = ", ".join(f"{c} long" for c in by)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:-1] != key or size >= PIECE:
                    if held:
                        out.append((*key, first, ",".join(held).encode()))
                    key, first, held, size = row[:-1], row[-1], [], 0
                held.append(str(row[-1]))
                size += len(held[-1]) + 1
            if out:
                yield _columns(out, [*by, "first"], "piece")
                out = []
        if held:
            yield _columns([(*key, first, ",".join(held).encode())], [*by, "first"], "piece")

    def _columns(out: list[tuple], longs: list[str], last: str) -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], [*longs, last])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:-2] != key:
                    if sha:
                        out.append((*key, sha.hexdigest().encode()))
                    key, sha = row[:-2], hashlib.sha256(row[-1])
                else:
                    sha.update(b"," + row[-1])
            if out:
                yield _columns(out, by, "sha")
        if sha:
            yield _columns([(*key, sha.hexdigest().encode())], by, "sha")
    n = partitions(spark)
    part = ends.select(*by, id_col).repartitionByRange(n, *by, id_col).sortWithinPartitions(*by, id_col).mapInArrow(pieces, f"{kinds}, first long, piece binary")
    return part.repartition(n, *by).sortWithinPartitions(*by, "first").mapInArrow(digests, f"{kinds}, sha binary") \
        .select(*by, F.col("sha").cast("string").alias("ends_sha256"))


def prefix_trie(turns: DataFrame, heads: int = HEADS, group: int = GROUP, fan: int = FAN, queue: int = QUEUE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows, convs = rebuilt(turns, heads, group)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 0") \
        .select(*[zero.alias(c) for c in KEY], "conv_id", "n", zero.alias("len"), zero.alias("c"), zero.alias("pa"), zero.alias("pb"))
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len"), F.max("c").alias("c"),
                                   F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = stored(nodes.unionByName(root), "trie-nodes")
    parent = nodes.select(F.col("d").alias("p_d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("p_conv"), F.col("n").alias("p_n"))
    tree = stored(nodes.withColumn("p_d", F.col("d") - 1).join(parent, ["p_d", "pa", "pb"], "left"), "trie-tree")
    children = tree.where("d > 0").groupBy(F.col("p_d").alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = rows.where("ends").select(*KEY, "conv_id").unionByName(convs.where("size = 0").select(*[zero.alias(c) for c in KEY], "conv_id"))
    digests = id_digests(stored(ends, "ends"), KEY, "conv_id")
    totals = subtree_totals(rows, convs, tree, fan, queue)
    out = tree.join(totals, ["conv_id", "n"]).join(children, KEY, "left").join(digests, KEY, "left")
    saved = (F.col("n") - 1) * (F.col("low_c") - F.col("c") + F.col("len")) + F.col("below")
    return out.select("conv_id", F.col("d").alias("depth"), F.col("p_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
