"""Prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations, in parallel blocks.

Conversations are sorted by the fingerprints of their turns, so those that begin alike are neighbours; lcp(i) is the number of turns that
conversation i shares with the one before. A trie node is an interval of the order with a depth: the nearest smaller values to the left and
right of an LCP bound it. Each block finds these within itself with a stack, where equal LCPs of an interval merge to one node. What stays
open at a block's edges (at most two rows a depth) finds its other block by the minima of the blocks, and there the place by the block's
stairs of prefix or suffix minima. The depths between a node and its parent are then written out, and all figures are aggregates of
intervals: differences of running sums, minima, and counts.

saved_tokens needs no walk over a subtree either: below a node of interval [l, r] and depth d, row i > l shares lcp(i) turns with the
row before, so the sum is that of the turns d .. lcp(i) over these rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, frugal_group, stored

MARK = 16
FAR, NONE = 1 << 62, 1 << 30
EMPTY = hashlib.sha256(b"").hexdigest()
SORTED = "block int, place long, conv_id long, n int, lcp int, shared long, total long, before array<long>, edge binary"
PARTS = (
    "kind string, block int, l long, depth int, above int, n long, conv long, kids long, leaves long, saved long, before array<long>, "
    "ends string, parent long, ref_block int, ref_side string, ref_v int"
)
FIELDS = [f.split()[0] for f in PARTS.split(", ")]
TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def rebuilt(conversations: DataFrame, heads: int = 6, every: int = 100) -> DataFrame:
    """(conv_id, key, sizes): every conversation with its first h turns replaced by those of conversation c - c % every; h = crc32(c) % heads.
    key holds 16 bytes of SHA-256 a turn, sizes the code points of its text."""
    said = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    mark = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * MARK)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), mark.alias("mark"), F.length("text").cast("long").alias("size"))
    own = said.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size"))).alias("turns"))
    first = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    theirs = F.coalesce(F.slice("head", F.lit(1), h), F.expr("cast(array() as array<struct<mark:string,size:bigint>>)"))
    turns = F.concat(theirs, F.slice("turns", h + 1, F.size("turns")))
    return both.select("conv_id", turns.alias("turns")).select("conv_id", F.unhex(F.array_join("turns.mark", "")).alias("key"), F.col("turns.size").alias("sizes"))


def _shared(a: bytes, b: bytes) -> int:
    """Leading turns that two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // MARK
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // MARK


def _number(batches):
    """Rows of a sorted partition with their place and LCP; the first and last keep their keys. before(d) is what depth d's turns before its
    last one hold, for the depths that the row is the first to reach."""
    block, place, last, held = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        out = []
        for conv, key, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lcp = _shared(last, key) if place else -1
            sums = np.concatenate(([0, 0], np.cumsum(sizes, dtype=np.int64)))  # sums[d]: before(d)
            out.append([block, place, conv, len(sizes), lcp, int(sums[lcp + 1]), int(sums[-1]), sums[lcp + 1 : len(sizes) + 1], None if place else key])
            place, last = place + 1, key
        if out:
            if held:
                yield _rows(held)
            held = out
    if held:
        held[-1][-1] = last
        yield _rows(held)


def _rows(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in SORTED.split(", ")])


def _edges(batches):
    for batch in batches:
        before, first = batch.column("before").to_pylist(), batch.column("first").to_pylist()
        lcp = [-1 if a is None else _shared(a, b) for a, b in zip(before, first, strict=True)]
        yield pa.record_batch([batch.column("block"), batch.column("n"), pa.array(lcp, pa.int32())], names=["block", "n", "lcp"])


class _Parts:
    def __init__(self):
        self.rows = []

    def add(self, kind: str, block: int, **more):
        self.rows.append({"kind": kind, "block": block, **more})

    def table(self) -> pa.Table:
        types = [TYPES[f.split()[1]] for f in PARTS.split(", ")]
        return pa.table([pa.array([r.get(f) for r in self.rows], t) for f, t in zip(FIELDS, types, strict=True)], names=FIELDS)


def _hash(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _block(sent):
    """The Cartesian tree of one block: complete nodes, what is open at its edges, its stairs and totals."""

    def run(key, table):
        numbers, base, first_lcp = sent.value
        b = int(np.searchsorted(numbers, key[0].as_py()))
        table = table.sort_by("place")
        conv, n, lcp, shared, total = (table.column(c).to_numpy().tolist() for c in ("conv_id", "n", "lcp", "shared", "total"))
        before, m, at = table.column("before").to_pylist(), len(conv), int(base[b])
        lcp[0] = int(first_lcp[b])  # of the row before it, in the block before
        shared[0] = before[0][lcp[0] + 1] if lcp[0] < n[0] else total[0]
        before[0] = before[0][lcp[0] + 1 :]
        following = lcp[1:] + [int(first_lcp[b + 1]) if b + 1 < len(numbers) else -1]
        ended = [f < x for f, x in zip(following, n, strict=True)]
        sums, leaves = np.concatenate(([0], np.cumsum(shared))).tolist(), np.concatenate(([0], np.cumsum(ended))).tolist()
        value, left, right, kids, least, latest, parent, first, node_of = [], [], [], [], [], [], [], [], []
        stack, opened, tail = [], [], FAR
        for i, v in enumerate(lcp):
            new = not (stack and value[stack[-1]] == v)
            while stack and value[stack[-1]] > v:
                x = stack.pop()
                right[x], least[x] = i, min(least[x], tail)
                tail = least[x]
                if stack and value[stack[-1]] >= v:
                    parent[x], new = stack[-1], value[stack[-1]] > v
                else:
                    parent[x], new = len(value), True  # the node that begins here
            if new:
                left.append(latest[stack[-1]] if stack else None)
                if not stack:
                    opened.append(len(value))
                stack.append(len(value))
                for some, x in ((value, v), (right, None), (kids, 0), (least, tail), (latest, i), (parent, None), (first, i)):
                    some.append(x)
            else:
                least[stack[-1]], latest[stack[-1]] = min(least[stack[-1]], tail), i
            kids[stack[-1]] += n[i] > v
            node_of.append(stack[-1])
            tail = conv[i]
        for x in reversed(stack):
            least[x] = tail = min(least[x], tail)  # over the rows from its left end to the block's

        def reference(x):
            if right[x] is not None and left[x] is not None:
                return {"parent": least[x]}
            return {"ref_block": b, "ref_side": "L" if right[x] is not None else "R", "ref_v": value[x]}

        parts = _Parts()
        own = {}  # runs of equal rows whose node is complete
        i = 0
        if lcp[0] == n[0]:
            while i < m and lcp[i] == n[i] == n[0]:
                i += 1
            parts.add("ends", b, ends=",".join(map(str, conv[:i])), ref_block=b, ref_side="L", ref_v=n[0])
        while i < m:
            k = i + 1
            while k < m and lcp[k] == n[k] == n[i]:
                k += 1
            if following[i] == n[i]:
                x = node_of[i + 1] if i + 1 < m else None
                if x is not None and right[x] is not None:
                    own[x] = _hash(conv[i:k])
                else:
                    parts.add("ends", b, ends=",".join(map(str, conv[i:k])), l=at + i)
            elif following[i] < n[i]:
                high, low = (lcp[i], node_of[i]) if lcp[i] >= following[i] else (following[i], node_of[i + 1] if i + 1 < m else None)
                refer = {} if high < 0 else reference(low) if low is not None else {"ref_block": b + 1, "ref_side": "L", "ref_v": high}
                parts.add("node", b, l=at + i, depth=n[i], above=high, n=1, conv=conv[i], kids=0, leaves=1, saved=0, before=before[i][high - lcp[i] :], ends=_hash(conv[i:k]), **refer)
            i = k
        for x, v in enumerate(value):
            l, q = left[x], right[x]
            if v < 0:
                continue  # the edge of the whole order
            if l is None or q is None:
                parts.add("open", b, depth=v, kids=kids[x], ref_side="B" if l is q else "L" if l is None else "R")
                continue
            high = max(lcp[l], lcp[q])
            refer = reference(parent[x]) if high >= 0 else {}
            parts.add("node", b, l=at + l, depth=v, above=high, n=q - l, conv=least[x], kids=kids[x] + (n[l] > v), leaves=leaves[q] - leaves[l], saved=sums[q] - sums[l + 1], before=before[l][high - lcp[l] : v - lcp[l]], ends=own.get(x, EMPTY), **refer)
        upto = NONE
        for x in reversed(stack):  # the last place below each depth, and the rows from it on
            l = latest[x]
            suffix = min(conv[l:]) if x == stack[-1] else suffix_of
            parts.add("right", b, l=at + l, depth=upto, above=value[x], n=n[l], conv=suffix, leaves=leaves[m] - leaves[l], saved=sums[m] - sums[l + 1], before=before[l])
            upto, suffix_of = value[x], least[x]
        upto, prefix = NONE, FAR
        for x in opened:  # the first place below each depth, and the rows before it
            parts.add("left", b, l=at + first[x], depth=upto, above=value[x], conv=prefix, leaves=leaves[first[x]], saved=sums[first[x]])
            upto, prefix = value[x], least[x]
        parts.add("block", b, depth=min(lcp), conv=min(conv), leaves=leaves[m], saved=sums[m])
        return parts.table()

    return run


class Blocks:
    """Minima and running sums of the blocks."""

    def __init__(self, least: np.ndarray, conv: np.ndarray, leaves: np.ndarray, saved: np.ndarray):
        self.least, self.minima = least, [conv]
        self.leaves, self.saved = np.concatenate(([0], np.cumsum(leaves))), np.concatenate(([0], np.cumsum(saved)))
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            half = 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def least_conv(self, a: int, b: int) -> int:
        """Of the blocks a .. b - 1."""
        if a >= b:
            return FAR
        level = (b - a).bit_length() - 1
        return int(min(self.minima[level][a], self.minima[level][b - (1 << level)]))

    def around(self, block: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest blocks to the left and right that have an LCP below the depth, -1 and the number of blocks without one."""
        lo, hi = np.empty(len(block), np.int64), np.empty(len(block), np.int64)
        for d in np.unique(depth):
            here, some = depth == d, np.concatenate(([-1], np.flatnonzero(self.least < d), [len(self.least)]))
            lo[here], hi[here] = some[np.searchsorted(some, block[here]) - 1], some[np.searchsorted(some, block[here], "right")]
        return lo, hi


def _across(sent):
    """For what is open: the blocks of its left and right ends, and the sums of those between."""

    def run(batches):
        blocks = Blocks(*sent.value)
        for batch in batches:
            block, depth = batch.column("block").to_numpy().astype(np.int64), batch.column("depth").to_numpy()
            side = np.array(batch.column("ref_side").to_pylist())
            lo, hi = blocks.around(block, depth)
            lo, hi = np.where(side == "R", block, lo), np.where(side == "L", block, hi)
            between = [blocks.least_conv(a + 1, z) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column("block"), batch.column("ref_side"), batch.column("depth"), batch.column("kids"), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(between, pa.int64()), pa.array(blocks.leaves[hi] - blocks.leaves[lo + 1]), pa.array(blocks.saved[hi] - blocks.saved[lo + 1])],
                names=["block", "side", "depth", "kids", "lo", "hi", "mid_conv", "mid_leaves", "mid_saved"],
            )

    return run


def _digests(batches):
    """(l, ends) of the pieces of id lists, which come in order; a list is hashed as it passes."""
    now, state, out = None, None, []
    for batch in batches:
        for l, text in zip(batch.column("l").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if l == now:
                state.update(b"," + text.encode())
                continue
            if state:
                out.append((now, state.hexdigest()))
            now, state = l, hashlib.sha256(text.encode())
    if state:
        out.append((now, state.hexdigest()))
    yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["l", "ends"])


def conversation_trie(conversations: DataFrame, heads: int = 6, every: int = 100) -> DataFrame:
    """One row per distinct beginning of a rebuilt conversation: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 (over the ids of the members that end there).

    Turns go by turn, null first; equal turns by the fingerprint of role and text, and repeated rows are turns of their own. A null role or
    text is empty. Rows without conv_id take no part. An empty table has no node, not even a root. Turns are compared by 128 bits of
    SHA-256 of role and text. Texts of any length are hashed where they lie; a conversation's fingerprints and sizes (24 bytes a turn) are
    one row. Other columns are ignored.

    The driver holds five numbers a block (a partition of the sort). Equal conversations are told apart by their ids in the sort, so a
    conversation that most others repeat is spread over blocks; the ids that end at its node are hashed as a stream of one string a block.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    order = rebuilt(conversations, heads, every).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = stored(order.mapInArrow(frugal(_number), SORTED), "sorted")
    ends = rows.filter("edge is not null").groupBy("block").agg((F.max("place") + 1).alias("n"), F.min_by("edge", "place").alias("first"), F.max_by("edge", "place").alias("last"))
    before = F.lag("last").over(Window.orderBy("block"))  # a row a block
    edges = sorted(ends.select("block", "n", "first", before.alias("before")).mapInArrow(_edges, "block int, n long, lcp int").collect())
    numbers, base, lcp = np.array([e[0] for e in edges], np.int64), np.cumsum([0] + [e[1] for e in edges]), np.array([e[2] for e in edges], np.int64)
    cut = spark.sparkContext.broadcast((numbers, base, lcp))
    parts = stored(rows.drop("edge").groupBy("block").applyInArrow(frugal_group(_block(cut)), PARTS), "trie-parts")
    blocks = sorted(parts.filter("kind = 'block'").select("block", "depth", "conv", "leaves", "saved").collect())
    sent = spark.sparkContext.broadcast([np.array([b[c] for b in blocks], np.int64) for c in range(1, 5)])

    opened = parts.filter("kind = 'open'").select("block", "ref_side", "depth", "kids")
    across = opened.mapInArrow(frugal(_across(sent)), "block int, side string, depth int, kids long, lo int, hi int, mid_conv long, mid_leaves long, mid_saved long")
    stair = lambda kind, end: parts.filter(F.col("kind") == kind).select(F.col("block").alias(end), *(F.col(c).alias(f"{kind}_{c}") for c in ("l", "depth", "above", "n", "conv", "leaves", "saved", "before")))
    inside = lambda kind: (F.col(f"{kind}_above") < F.col("depth")) & (F.col("depth") <= F.col(f"{kind}_depth"))
    placed = across.join(stair("right", "lo"), "lo").filter(inside("right"))
    placed = placed.join(stair("left", "hi"), "hi", "left").filter(F.col("left_l").isNull() | inside("left"))
    named = stored(placed.select("block", "side", "depth", "kids", "lo", "hi", F.col("right_l").alias("l"), F.col("right_above").alias("lo_v"), F.coalesce("left_above", F.lit(-1)).alias("hi_v"), F.coalesce("left_l", F.lit(int(base[-1]))).alias("q"), F.col("right_n").alias("row_n"),
        F.least("right_conv", "mid_conv", F.coalesce("left_conv", F.lit(FAR))).alias("conv"), (F.col("right_leaves") + F.col("mid_leaves") + F.coalesce("left_leaves", F.lit(0))).alias("leaves"),
        (F.col("right_saved") + F.col("mid_saved") + F.coalesce("left_saved", F.lit(0))).alias("saved"), F.col("right_before").alias("before")), "open-nodes")
    names = named.select("block", F.explode(F.when(F.col("side") == "B", F.array(F.lit("L"), F.lit("R"))).otherwise(F.array("side"))).alias("side"), "depth", "l", F.col("conv").alias("known"))
    names = names.select(F.col("block").alias("ref_block"), F.col("side").alias("ref_side"), F.col("depth").alias("ref_v"), "l", "known")
    high = F.greatest("lo_v", "hi_v")
    same = [F.first(c).alias(c) for c in ("lo", "hi", "lo_v", "hi_v", "q", "row_n", "conv", "leaves", "saved", "before")]
    joined = named.groupBy("l", "depth").agg(F.sum("kids").alias("kids"), *same).withColumn("above", high)
    pieces = parts.filter("kind = 'ends'").select("block", "l", "ends", "ref_block", "ref_side", "ref_v")
    late = pieces.filter("l is null").drop("l").join(names.drop("known"), ["ref_block", "ref_side", "ref_v"]).select("block", "l", "ends")
    listed = pieces.filter("l is not null").select("block", "l", "ends").union(late).repartition("l").sortWithinPartitions("l", "block")
    hashes = listed.mapInArrow(_digests, "l long, ends string").withColumnRenamed("ends", "hash")
    own = F.col("row_n") == F.col("depth")
    from_left = F.col("lo_v") >= F.col("hi_v")
    closed = joined.join(hashes, "l", "left").select("l", "depth", "above", (F.col("q") - F.col("l")).alias("n"), "conv", (F.col("kids") + (F.col("row_n") > F.col("depth")).cast("long")).alias("kids"), "leaves", "saved",
        F.slice("before", F.col("above") - F.col("lo_v") + 1, F.col("depth") - F.col("above")).alias("before"), F.when(own, F.col("hash")).otherwise(EMPTY).alias("ends"), F.lit(None).cast("long").alias("parent"),
        F.when(high >= 0, F.when(from_left, F.col("lo")).otherwise(F.col("hi"))).alias("ref_block"), F.when(from_left, "R").otherwise("L").alias("ref_side"), high.alias("ref_v"))
    nodes = parts.filter("kind = 'node'").select(*closed.columns).union(closed)
    nodes = nodes.join(names.drop("l"), ["ref_block", "ref_side", "ref_v"], "left").withColumn("parent", F.coalesce("parent", "known"))
    deep = nodes.select("*", F.posexplode("before").alias("up", "so_far")).withColumn("d", F.col("above") + 1 + F.col("up"))
    last = F.col("d") == F.col("depth")
    return deep.select(F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") > 0, F.when(F.col("up") == 0, F.col("parent")).otherwise(F.col("conv"))).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - (F.col("n") - 1) * F.col("so_far")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"))
