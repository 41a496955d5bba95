"""Trie of conversation prefixes, built from sorted shards and a skeleton of splitter paths.

A conversation is the row of its turns' digests. Such rows are cut into shards by splitters, (path, conv_id)
pairs drawn from a hashed sample, and every shard is sorted. The subtree of a node is then a run of rows, and only
nodes on the path of a splitter can lie in more than one shard: these are the skeleton, whose paths are broadcast.
A shard walks through its rows once with a stack and finishes all other nodes alone; for skeleton nodes it returns
partial aggregates, which are summed over the shards and then up the skeleton.

Equal conversations differ in conv_id, so a path that a third of all conversations share is cut into as many shards
as its rows need. Texts are not moved: a turn is 16 bytes of SHA-256 and its length. A conversation of more than
``HEAD`` turns whose first ``HEAD`` turns nobody shares keeps only these in its row: what follows is a chain of nodes
of its own, written turn by turn. Only one that shares them is a row of 20 bytes for each turn.

Odd rows: turns without a conv_id belong to no conversation and give nothing. A null role or text is the empty one.
Turns of equal number go by role and digest. Rows that repeat are turns of their own. An empty table has no nodes, not even
a root. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import stored

DIGEST = 16
#: Turns of a conversation that are always kept in one row.
HEAD = 256
#: Rows of a shard, as long as ``MOST_SHARDS`` suffice; rows of the sample for each splitter.
SHARD_ROWS, MOST_SHARDS, OVERSAMPLE = 4096, 4096, 8
#: Turns of the rebuilding: conversations of one hundred share up to five of the first one's turns.
FAMILY, SHARED = 100, 6
_SLICE = 256
_OUT_ROWS = 8192

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- conversations ------------------------------------------------------------------------

def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, size): what the trie needs of a turn; ``size`` in code points."""
    kind = conversations.schema["conv_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"conv_id must be an integer, not {kind}")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("size"))


def numbered(turns: DataFrame) -> DataFrame:
    """The turns with ``at``, their place in the conversation from 0.

    Conversations are ordered in slices of ``_SLICE`` turn numbers and the slices' counts give the offsets, so that a
    conversation which holds most turns is never sorted in one task.
    """
    sliced = turns.withColumn("part", F.floor(F.col("turn") / _SLICE))
    counts = sliced.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first())
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.sum("n").over(before) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    ranked = sliced.withColumn("rn", F.row_number().over(inside))
    return ranked.join(offsets, (F.col("conv_id") == F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).select(
        "conv_id", (F.col("offset") + F.col("rn") - 1).alias("at"), "digest", "size")


def rebuilt_heads(conv_id: Column) -> Column:
    """Number of turns a conversation takes from the first one of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first one of their hundred.

    Returns one row per conversation (conv_id, head: its borrowed turns, total) and its own turns (conv_id, at, digest,
    size) with their places after the borrowed ones.
    """
    counts = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("at") < SHARED - 1, F.struct("at", "digest", "size")))).alias("first"))
    bases = counts.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), "first")
    h = rebuilt_heads(F.col("conv_id")).cast("int")
    convs = counts.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(bases, "base", "left")
    convs = convs.select(
        "conv_id", "h", F.slice(F.coalesce("first", F.array()), F.lit(1), F.col("h")).alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest")).select(
        "conv_id", "h", F.transform("head", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("head"),
        (F.size("head") + F.col("rest")).alias("total"))
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("k")), "conv_id").filter(F.col("at") >= F.col("h")).select(
        "conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "digest", "size")
    return convs.select("conv_id", "head", "total"), own


def paths(convs: DataFrame, own: DataFrame, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conv_id, path, sizes, total) and the own turns left out of the paths, which nobody shares."""
    def rows(turns: DataFrame) -> DataFrame:
        listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "size"))).alias("own"))
        both = convs.join(listed, "conv_id", "left").withColumn("own", F.transform(
            F.coalesce("own", F.array()), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))))
        every = F.concat("head", "own")
        return both.select("conv_id", F.unhex(F.array_join(F.transform(every, lambda t: F.hex(t["digest"])), "")).alias("path"),
                           F.transform(every, lambda t: t["size"]).alias("sizes"), "total")

    short = rows(own.filter(F.col("at") < head))
    long = short.filter(F.col("total") >= head).select("conv_id", F.sha2("path", 256).alias("d"))
    met = long.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = long.join(met, "d").select("conv_id")
    whole = rows(own.join(shared, "conv_id"))
    cut = stored(short.join(shared, "conv_id", "left_anti").unionByName(whole.join(shared, "conv_id")), "trie-paths")
    tails = own.filter(F.col("at") >= head).join(shared, "conv_id", "left_anti")
    return cut, tails


# ---- shards -------------------------------------------------------------------------------

Splitter = tuple[bytes, int]


def splitters(rows: DataFrame, shard_rows: int = SHARD_ROWS, head: int = HEAD) -> list[Splitter]:
    """At most ``MOST_SHARDS`` splitters, from a sample of ``OVERSAMPLE`` rows for each; the driver holds no more.

    A path of more than ``head`` turns is cut there: its beginning separates rows as well.
    """
    n = rows.count()
    shards = min(-(-n // shard_rows), MOST_SHARDS)
    if shards < 2:
        return []
    rate = min(1.0, OVERSAMPLE * shards / n)
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("splitter"), "conv_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    fits = F.octet_length("path") <= head * DIGEST
    sample = sorted((bytes(r[0]), r[1]) for r in drawn.select(
        F.substring("path", 1, head * DIGEST).alias("path"), F.when(fits, F.col("conv_id")).otherwise(F.lit(-(1 << 63)))).collect())
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST  # the first ``low`` turns agree, the first ``high`` do not all
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST: mid * DIGEST] == b[low * DIGEST: mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low if a[: high * DIGEST] != b[: high * DIGEST] else high


def node_id(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * DIGEST]).digest()[:DIGEST]


class _Node:
    __slots__ = ("smallest", "members", "children", "leaves", "saved", "size", "ends", "text", "waiting")

    def __init__(self, size: int):
        self.smallest, self.members, self.children, self.leaves, self.saved, self.size = None, 0, 0, 0, 0, size
        self.ends = None      # hash of the members that end here
        self.text = None      # their decimal ids, in skeleton nodes only
        self.waiting: list[tuple] = []  # rows of finished children, which lack this node's smallest member


SHARD_SCHEMA = pa.schema([
    ("kind", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("ancestors", pa.list_(pa.binary())), ("shard", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.binary()), ("ends_sha256", pa.string())])
SHARD_DDL = ("kind string, node binary, parent binary, ancestors array<binary>, shard long, conv_id long, depth long, parent_conv_id long, "
             "n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends binary, ends_sha256 string")
DONE, HANGING, PARTIAL = "done", "hanging", "partial"


class ShardWalk:
    """One shard's sorted rows, one after the other; ``rows`` fills with finished nodes and partial aggregates."""

    def __init__(self, shard: int, bounds: list[bytes]):
        self.shard, self.bounds = shard, bounds
        self.path, self.stack, self.rows, self.depth_shared = b"", [_Node(0)], [], 0

    def _skeleton_depth(self, path: bytes) -> int:
        """Nodes of the path down to this depth are on a splitter's path, hence may go on in another shard."""
        return max((_shared(path, b) for b in self.bounds), default=0)

    def add(self, conv_id: int, path: bytes, sizes, total: int) -> None:
        common = _shared(self.path, path)
        self._close(common)
        self.path = path
        self.depth_shared = self._skeleton_depth(path)
        while len(self.stack) <= len(path) // DIGEST:
            self.stack.append(_Node(sizes[len(self.stack) - 1]))
        top = self.stack[-1]
        # Counts go to the deepest node and move up as nodes close.
        top.members += 1
        top.smallest = conv_id if top.smallest is None else min(top.smallest, conv_id)
        if total > len(path) // DIGEST:  # the rest is a chain that this conversation has for itself
            top.children += 1
            top.leaves += 1
        elif len(self.stack) - 1 <= self.depth_shared:
            top.text = [] if top.text is None else top.text
            top.text.append(str(conv_id))
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv_id).encode())
        else:
            top.ends.update(b"," + str(conv_id).encode())

    def _close(self, depth: int) -> None:
        while len(self.stack) - 1 > depth:
            self._pop()

    def _pop(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if up is not None:
            up.members += node.members
            up.smallest = node.smallest if up.smallest is None else min(up.smallest, node.smallest)
        if depth <= self.depth_shared:
            text = ",".join(node.text).encode() if node.text else None
            ids = [node_id(self.path, k) for k in range(depth + 1)]
            self._settle(node, ids[-1])
            self.rows.append((PARTIAL, ids[-1], ids[-2] if depth else None, ids, self.shard, node.smallest, depth, None, node.members, node.children,
                              node.leaves, node.saved, node.size, text, None))
            return
        if not node.children:
            node.leaves = 1
        node.saved += (node.members - 1) * node.size
        for row in node.waiting:
            self.rows.append((DONE, None, None, None, self.shard, row[0], depth + 1, node.smallest, *row[1:]))
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        up.waiting.append((node.smallest, node.members, node.children, node.leaves, node.saved, node.size, None,
                           node.ends.hexdigest() if node.ends else EMPTY_SHA))
        if depth - 1 <= self.depth_shared and len(up.waiting) >= 1024:  # a skeleton node's children need not wait
            self._settle(up, node_id(self.path, depth - 1), depth)

    def _settle(self, node: _Node, ident: bytes, depth: int | None = None) -> None:
        depth = len(self.stack) + 1 if depth is None else depth
        for row in node.waiting:
            self.rows.append((HANGING, None, ident, None, self.shard, row[0], depth, None, *row[1:]))
        node.waiting = []

    def end(self) -> None:
        self._close(0)
        self._pop()


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), _OUT_ROWS):
        columns = list(zip(*rows[i: i + _OUT_ROWS]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SHARD_SCHEMA)], schema=SHARD_SCHEMA)


def walk_shards(rows: DataFrame, cuts: list[Splitter]) -> DataFrame:
    """Finished nodes, nodes that hang below a skeleton node, and the skeleton's partial aggregates."""
    known = rows.sparkSession.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect.bisect_right(known.value, k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names=["shard", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: ShardWalk | None = None
        for batch in batches:
            for shard, conv_id, path, sizes, total in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes", "total"))):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.end()
                        yield from _batches(now.rows)
                    cuts_here = known.value[max(shard - 1, 0): shard + 1]
                    now = ShardWalk(shard, [p for p, _ in cuts_here])
                now.add(conv_id, path, sizes, total)
                if len(now.rows) >= _OUT_ROWS:
                    yield from _batches(now.rows)
                    now.rows = []
        if now is not None:
            now.end()
            yield from _batches(now.rows)

    placed = rows.select("conv_id", "path", "sizes", "total").mapInArrow(place, "shard long, conv_id long, path binary, sizes array<int>, total long")
    dealt = placed.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return stored(dealt.mapInArrow(walk, SHARD_DDL), "trie-nodes")


# ---- skeleton -----------------------------------------------------------------------------

def _end_hashes(partial: DataFrame) -> DataFrame:
    """(node, ends_sha256): the shards' lists of ids hashed one after the other; none is held beside another."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for ident, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if ident != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = ident, hashlib.sha256(ends)
                else:
                    state.update(b",")
                    state.update(ends)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    lists = partial.filter(F.col("ends").isNotNull()).select("node", "shard", "ends")
    return lists.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(hashes, "node binary, ends_sha256 string")


def reduce_skeleton(partial: DataFrame) -> DataFrame:
    """Skeleton nodes (node, parent, conv_id, depth, n_convs, ...) from the shards' partial aggregates."""
    one = partial.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("ancestors").alias("ancestors"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("plain"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.first("size").alias("size"))
    one = stored(one, "trie-skeleton")
    inner = one.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("inner")).filter(F.col("node").isNotNull())
    own = one.join(inner, "node", "left").withColumn("n_children", F.col("plain") + F.coalesce("inner", F.lit(0)))
    up = own.select(F.explode("ancestors").alias("node"),
                    (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("l"),
                    (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("s"))
    sums = up.groupBy("node").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    return own.join(sums, "node").join(_end_hashes(partial), "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows: DataFrame, tails: DataFrame | None = None, shard_rows: int = SHARD_ROWS, head: int = HEAD) -> DataFrame:
    """Nodes of the trie over (conv_id, path, sizes, total) rows and the turns their paths leave out."""
    nodes = walk_shards(rows, splitters(rows, shard_rows, head))
    skeleton = stored(reduce_skeleton(nodes.filter(F.col("kind") == PARTIAL)), "trie-skeleton-nodes")
    heads = skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.filter(F.col("kind") == DONE).select(*COLUMNS)
    hanging = nodes.filter(F.col("kind") == HANGING).drop("parent_conv_id").join(heads, "parent").select(*COLUMNS)
    out = done.unionByName(hanging).unionByName(skeleton.join(heads, "parent", "left").select(*COLUMNS))
    if tails is None:
        return out
    n = rows.select("conv_id", "total")
    last = F.col("at") + 1 == F.col("total")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return out.unionByName(tails.join(n, "conv_id").select(
        "conv_id", (F.col("at") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, head: int = HEAD) -> DataFrame:
    """The trie of rebuilt conversations, one row per node."""
    turns = stored(numbered(turn_digests(conversations)), "trie-turns")
    convs, own = rebuild(turns)
    rows, tails = paths(convs, own, head)
    return trie(rows, tails, shard_rows, head)
