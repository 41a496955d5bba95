"""Minimax contiguous shards, with DataFrame functions only.

Documents with equal texts form one atomic group. Groups are ordered by the digest of their text; the smallest
capacity under which the ordered groups fill at most ``shards`` contiguous runs is found by binary search, each
trial checked greedily. The order is summarised as a tree of digest prefixes: the driver holds the sizes of
``16 ** LEVEL`` prefixes and asks for finer ones only where a cut of a trial falls inside a prefix, so what it
holds does not grow with the number of groups. Where single groups set the capacity, each gets a shard of its own
and the cuts between them aim at equal shares of the rest, never above the capacity.

Inputs: a null text is the empty text. Rows that repeat an id are each placed, and rows that repeat altogether are
numbered as one row with a count. A null ``doc_id`` is placed like any other. Extra columns are ignored. Shards are
empty only when there are fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import stored

SHARDS = 24
LEVEL = 3
#: Rows numbered by one task at a time.
SLICE_ROWS = 200_000
#: Copies of one row that are written out at a time.
RUN = 4096
OVERHEAD = 8


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.sha2(text, 256).alias("key"))


class Outline:
    """Ordered digest prefixes with bytes and groups below each; finer prefixes are fetched on demand."""

    def __init__(self, groups: DataFrame, level: int = LEVEL):
        self.groups = groups
        self.rows: list[tuple[str, int, int]] = self._fetch([""], level)
        self._sum()

    def _fetch(self, prefixes: list[str], more: int) -> list[tuple[str, int, int]]:
        length = len(prefixes[0]) + more
        rows = self.groups
        if prefixes != [""]:
            rows = rows.filter(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
        # At most len(prefixes) * 16 ** more rows, whatever the number of groups.
        return [(r["p"], r["b"], r["n"]) for r in rows.groupBy(F.substring("key", 1, length).alias("p")).agg(
            F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()]

    def _sum(self) -> None:
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if self.ends else 0
        self.prefixes = [r[0] for r in self.rows]
        self.behind = list(accumulate((r[2] for r in reversed(self.rows)), initial=0))[::-1]  # groups from a leaf on

    def before(self, leaf: int) -> int:
        return self.ends[leaf - 1] if leaf else 0

    def nearest(self, target: float) -> tuple[int, int | None]:
        """The leaf before which bytes come closest to the target, and the leaf around it if it could be cut inside."""
        n, inside = self.below(int(target))
        if n < len(self.rows) and abs(self.ends[n] - target) < abs(self.before(n) - target):
            n += 1
        return n, inside

    def leaf(self, key: str) -> int:
        return bisect_right(self.prefixes, key) - 1

    def isolate(self, keys: list[str]) -> None:
        """Refines until each of the groups is a leaf of its own."""
        while crowded := {i for i in map(self.leaf, keys) if self.rows[i][2] > 1}:
            self.refine(crowded)

    def refine(self, at: set[int]) -> None:
        """Two more digits below each of the given leaves that holds several groups."""
        by_length: dict[int, list[str]] = {}
        for i in at:
            by_length.setdefault(len(self.rows[i][0]), []).append(self.rows[i][0])
        gone = {self.rows[i][0] for i in at}
        fresh = [r for prefixes in by_length.values() for r in self._fetch(sorted(prefixes), 2)]
        self.rows = sorted([r for r in self.rows if r[0] not in gone] + fresh)
        self._sum()

    def below(self, limit: int) -> tuple[int, int | None]:
        """Leaves that end within ``limit`` bytes, and the leaf that holds the limit if it could be cut inside."""
        n = bisect_right(self.ends, limit)
        start = self.ends[n - 1] if n else 0
        return n, n if n < len(self.rows) and self.rows[n][2] > 1 and limit > start else None

    def greedy(self, capacity: int, shards: int) -> tuple[list[int] | None, set[int]]:
        """Leaf index behind each shard when filled in order, None if it takes more shards; and leaves too coarse to tell."""
        cuts, at, coarse = [], 0, set()
        while at < len(self.rows) and len(cuts) < shards:
            n, inside = self.below((self.ends[at - 1] if at else 0) + capacity)
            if inside is not None:
                coarse.add(inside)
            if n == at:  # a leaf of several groups larger than what is left
                return None, coarse
            cuts.append(n)
            at = n
        return (cuts if at >= len(self.rows) else None), coarse

    def backward(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Earliest leaf index at which shard s may begin so that the rest still fits."""
        starts, end, coarse = [0] * (shards + 1), len(self.rows), set()
        starts[shards] = end
        for s in range(shards - 1, -1, -1):
            floor = (self.ends[end - 1] if end else 0) - capacity
            n = bisect_left(self.ends, floor) + 1 if floor > 0 else 0  # leaves that must stay before this shard
            if n and self.ends[n - 1] > floor and self.rows[n - 1][2] > 1:
                coarse.add(n - 1)
            starts[s] = end = min(n, end)
        return starts, coarse


def smallest_capacity(outline: Outline, largest: int, shards: int) -> int:
    """Binary search between the mean load or largest group, and that plus one group, which always suffices."""
    low = max(-(-outline.total // shards), largest)
    high = -(-outline.total // shards) + largest
    while low < high:
        mid = (low + high) // 2
        while True:
            cuts, coarse = outline.greedy(mid, shards)
            if cuts is not None or not coarse:
                break
            outline.refine(coarse)
        low, high = (low, mid) if cuts is not None else (mid + 1, high)
    return low


def even_share(total: int, shards: int, sizes: list[int]) -> float:
    """Bytes for each shard when groups larger than that have shards of their own."""
    for size in sorted(sizes, reverse=True):
        if shards == 1 or size * shards <= total:
            break
        total, shards = total - size, shards - 1
    return total / shards


def boundaries(outline: Outline, capacity: int, shards: int, large: list[tuple[str, int]]) -> list[str]:
    """The digest prefix at which each shard but the first begins; an empty shard begins where the next one does.

    ``large`` are the ``shards`` largest groups, since no more of them can have a shard of their own.
    """
    outline.isolate([key for key, _ in large])
    while True:
        starts, coarse = outline.backward(capacity, shards)
        places = sorted((outline.leaf(key), size) for key, size in large)
        firsts, at, doubtful = [], 0, set(coarse)
        for s in range(shards - 1):
            base, left = outline.before(at), shards - s
            ahead = [(i, size) for i, size in places if i >= at]
            share = even_share(outline.total - base, left, [size for _, size in ahead])
            big, size = next(((i, size) for i, size in ahead if size > share), (None, 0))
            lowest, (highest, inside) = starts[s + 1], outline.below(base + capacity)
            if big is not None and (gap := outline.before(big) - base) <= 1.5 * share:
                alone = big > at and (gap + size > capacity or 2 * gap >= share)
                near = big if alone else big + 1
            else:
                part = share if big is None else gap / round(gap / share)
                near, within = outline.nearest(base + part)
                if within is not None:
                    doubtful.add(within)
            if inside is not None and near >= highest:
                doubtful.add(inside)
            near = max(min(near, highest), lowest, at)
            # A shard holds a group as long as there are any, and leaves one for each shard behind it.
            while near > at and near > lowest and outline.behind[near] < left - 1:
                near -= 1
            if near == at < len(outline.rows) and outline.behind[at] >= left:
                near = min(at + 1, highest)
                if outline.rows[at][2] > 1:
                    doubtful.add(at)
            firsts.append(at := near)
        if not doubtful:
            return [outline.rows[i][0] if i < len(outline.rows) else "g" for i in firsts]
        outline.refine(doubtful)


def _numbered(placed: DataFrame, slice_rows: int) -> DataFrame:
    """Gapless numbers in each shard: rows before it in its slice plus the rows of the slices before.

    Slices are dealt by a hash of the row, so a shard that one huge group fills is many slices as well. Equal rows are one
    row with a count until they are numbered."""
    distinct = placed.groupBy("shard", "doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("copies"))
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).collect()  # one row per shard
    width = max([1, *(-(-r["rows"] // slice_rows) for r in counts)]) * 4
    sliced = distinct.withColumn("slice", F.pmod(F.xxhash64("doc_id", "key"), F.lit(width)))
    sizes = sliced.groupBy("shard", "slice").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("shard", "slice").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("rank", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).join(offsets, ["shard", "slice"])
    first = F.col("before") + F.col("rank")
    # In two steps, so that no array grows with the number of copies beyond its square root or so.
    runs = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("run"))
    last = F.least(F.col("copies") - 1, F.col("run") * RUN + RUN - 1)
    return runs.select("*", F.explode(F.sequence(F.col("run") * RUN, last)).alias("copy")).withColumn("slot", first + F.col("copy"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slice_rows: int = SLICE_ROWS, level: int = LEVEL) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity; see the module's text."""
    rows = stored(keyed(docs), "sized")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    outline = Outline(groups, level)
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    capacity = smallest_capacity(outline, largest, shards)
    large = groups.orderBy(F.col("bytes").desc(), "key").limit(shards).select("key", "bytes").collect()
    firsts = boundaries(outline, capacity, shards, [tuple(r) for r in large])
    shard: Column = sum([(F.col("key") >= first).cast("int") for first in firsts], F.lit(0))
    placed = stored(rows.withColumn("shard", shard), "placed")
    return _numbered(placed, slice_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
