"""Nearest neighbours, semantic-cache lookups and cache-threshold calibration.

Neighbour search is exact and never emits pairs as rows. Entries are grouped around pivot vectors
into cells, the cells are laid one after the other and cut into a few blocks of bounded size, and a
task takes one block of entries and one chunk of queries, multiplies them a tile at a time and keeps
k candidates per query. A row is sent to few tasks, whatever the number of cells. A block or a cell
is skipped for a query only when the triangle inequality proves that nothing in it can be near
enough. Hot cells and hot scopes become more blocks, not bigger ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import stats
from plumbline.operators.ranking import join_null_safe, top_n
from plumbline.operators.routing import at_thresholds, grid_bucket, require_one_split
from plumbline.session import shared_dir, stored

# ---- fixed values -------------------------------------------------------------------------
CACHE_GRID = tuple(round(0.80 + i * 0.005, 4) for i in range(41))
MAX_FALSE_HIT_RATE = 0.01
MIN_HIT_RATE = 0.05
TOLERANCES = (0.01, 0.02, 0.03, 0.05, 0.10)
# -------------------------------------------------------------------------------------------

SCALE = float(1 << 24)
BLOCK_ROWS = 1024
CHUNK_ROWS = 1024
MAX_PIVOTS = 2048
SLACK = 1e-6
TRAINING_SPLITS = ("calibration", "dev")
CLOSENESS = float(1 << 30)
DRAWN = 16
# Rows and columns that are ruled out together, and the share of dimensions that is looked at first.
TILE = 64
HEAD_SHARE = 4
MARKS = 32
# Rows on each side of a task at most, and parts of a side below that. From SIDE * BLOCK_ROWS to SIDE * TASK_ROWS rows a
# side has SIDE parts, so a row is copied as often at every size. HOME_SIDE: parts of the queries of a block's own cells.
TASK_ROWS, SIDE, HOME_SIDE = 3 << 15, 8, 2
# Rows that Python takes at once from a stream, and pairs that are multiplied exactly at once.
BATCH_ROWS, PAIRS_AT_ONCE = 1024, 1 << 15
# Groups of tiles for which the first dimensions are not tried after they ruled out little. Error of a rough product a dimension.
SELDOM, ROUGH = 7, 2.0 ** -23
LONGEST = float(1 << 63)
# Squares of lengths below this keep every sum of a distance under 2^53, where doubles are exact.
EXACT_SQUARE = float(1 << 51)


# ---- vector columns -----------------------------------------------------------------------

def fixed_point(vector: Column) -> Column:
    """Components as whole numbers, so dot products are exact in any summation order."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE + 0.5).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two fixed-point vectors; 0 when either has no length, an error on a mismatch."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("dimension mismatch")).cast("double")).otherwise(value)


# ---- exact neighbour search ---------------------------------------------------------------

def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(flat)
    sizes = pa.compute.list_value_length(flat).unique().to_pylist()
    if len(sizes) > 1 or None in sizes:
        raise ValueError(f"vectors must have one number of dimensions, found {sizes}")
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _whole(matrix: np.ndarray) -> np.ndarray:
    """Components as the whole numbers of ``fixed_point``."""
    return np.clip(np.nan_to_num(np.floor(matrix.astype(float) * SCALE + 0.5), nan=0.0, posinf=LONGEST, neginf=-LONGEST), -LONGEST, LONGEST)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _gaps(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors and pivots."""
    return np.sqrt(np.clip(2.0 - 2.0 * (_unit(matrix) @ pivots.T), 0.0, None))


def _pick_pivots(entries: DataFrame, count: int) -> np.ndarray:
    """Up to MAX_PIVOTS entries in hash order: a bounded number of rows by construction."""
    chosen = entries.orderBy(F.md5(F.col("eid").cast("string")), "eid").select(fixed_point(F.col("vec")).alias("vec")).limit(min(count, MAX_PIVOTS)).collect()
    return _unit(np.array([r["vec"] for r in chosen], dtype=float)) if chosen else np.zeros((1, 1))


def _with_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot's number and the distance to it."""
    if len(pivots) <= 1:
        return df.select("*", F.lit(0).alias("cell"), F.lit(2.0).alias("gap"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                gaps = _gaps(_whole(_matrix(batch.column("vec"))), pivots)
                nearest = gaps.argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(nearest), pa.array(gaps.min(axis=1))], names=[*batch.schema.names, "cell", "gap"])

    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    return df.mapInArrow(assign, schema)


class _Blocks:
    """Entries in the order of their cells, cut into blocks of about ``rows``; at most MAX_PIVOTS cells.

    A small cell shares its block with the next ones, a large one goes on in several blocks, over which its entries are
    dealt by the hash of their id.
    """

    def __init__(self, cells: list[tuple[int, int, float]], least: int) -> None:
        self.cells = np.array([c for c, _, _ in cells], np.int32)
        self.sizes = np.array([n for _, n, _ in cells], np.int64)
        self.radius = np.array([r for _, _, r in cells], float)
        total = int(self.sizes.sum())
        self.rows = max(1, least, min(TASK_ROWS, -(-total // SIDE)))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first, self.last = self.starts // self.rows, (self.starts + self.sizes - 1) // self.rows
        self.count = -(-total // self.rows)
        #: Whether a cell has entries in a block.
        self.holds = (self.first[:, None] <= np.arange(self.count)) & (np.arange(self.count) <= self.last[:, None])

    def place(self, placed: DataFrame) -> DataFrame:
        """Adds every entry's block."""
        if not len(self.cells):
            return placed.withColumn("block", F.lit(0))
        # By number of the cell, as literals: a join would send the vectors over the network once more.
        start, size = np.zeros((2, int(self.cells.max()) + 1), np.int64)
        start[self.cells], size[self.cells] = self.starts, self.sizes
        of = lambda numbers: F.element_at(F.lit(numbers.tolist()).cast("array<bigint>"), F.col("cell") + 1)
        return placed.withColumn("block", F.floor((of(start) + F.pmod(F.xxhash64("eid"), of(size))) / self.rows).cast("int"))


def _visits(queries: DataFrame, blocks: _Blocks, pivots: np.ndarray, home: bool | None) -> DataFrame:
    """One row per (query, block that may still hold a near enough entry), at most as many as there are blocks.

    ``queries`` carries ``reach``: the distance beyond which nothing matters, NULL if unknown. ``home``: only the blocks
    of the query's own cell, or only the others; None: all. Radii are the largest over all scopes, so that no block is
    left out wrongly.
    """
    if blocks.count <= 1 or len(pivots) <= 1:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks.count - 1))).alias("block") if blocks.count else F.lit(0).alias("block")
        return queries.select("*", every).filter(F.lit(blocks.count > 0 and (home is not False or blocks.count > 1)))
    kept, others = queries.columns, [i for i in range(len(pivots)) if i not in set(blocks.cells.tolist())]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                gaps = _gaps(_whole(_matrix(batch.column("vec"))), pivots)
                gaps[:, others] = np.inf
                own = blocks.holds[np.searchsorted(blocks.cells, gaps.argmin(axis=1))]
                if home:
                    needed = own
                else:
                    near = gaps[:, blocks.cells] - blocks.radius[None, :] <= _reach(batch.column("reach"))[:, None] + SLACK
                    needed = near.astype(np.float32) @ blocks.holds.astype(np.float32) > 0
                    if home is False:
                        needed &= ~own
                row, at = np.nonzero(needed)
                for part in range(0, len(row), BATCH_ROWS):
                    taken = slice(part, part + BATCH_ROWS)
                    out = batch.select(kept).take(pa.array(row[taken], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at[taken], pa.int32())], names=[*kept, "block"])

    return queries.mapInArrow(choose, T.StructType([*queries.schema.fields, T.StructField("block", T.IntegerType())]))


def _reach(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Distances; an unknown one is unbounded."""
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    values = values.astype(float)
    return np.where(np.isnan(values), np.inf, values)


def _keep_best(values: np.ndarray, places: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
    """Puts hits among the best of their rows; of equal ones the lower place stays."""
    better = (value > values[row, -1]) | ((value == values[row, -1]) & (place < places[row, -1]))
    if not better.any():
        return
    held, at = np.unique(row[better], return_inverse=True)
    k = values.shape[1]
    r = np.concatenate([np.repeat(np.arange(len(held)), k), at])
    v = np.concatenate([values[held].ravel(), value[better]])
    p = np.concatenate([places[held].ravel(), place[better]])
    sort = np.lexsort((p, -v, r))
    r, v, p = r[sort], v[sort], p[sort]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    values[held], places[held] = v[first].reshape(-1, k), p[first].reshape(-1, k)


def _nearest(a: np.ndarray, b: np.ndarray, k: int, low: np.ndarray, own: np.ndarray, a_gaps: np.ndarray | None,
             b_cell: np.ndarray, b_gap: np.ndarray, block_rows: int, chunk_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, column, similarity) of the k best columns of every row, and how many pairs were multiplied out.

    ``low`` is a similarity below which a row needs nothing; it rises to the k-th best found so far, and no more than
    the k best of a row are held. Rows lie in tiles by the nearest of a few marks, columns by their cell, the nearest
    mark and the distance to the cell's pivot; ``a_gaps`` are the rows' distances to the pivots of the cells. Tiles are
    left out if the triangle inequality, columns if the dot product of the first dimensions plus the product of what is
    left of both lengths (Cauchy-Schwarz), shows that all their pairs are below; where that rules out little it is tried
    only now and then. What is left is multiplied roughly, and exactly where the rough number does not rule a pair out.
    Components are whole numbers, so every order of sums gives the same.
    """
    lengths = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    ua, ub = (_unit(x).astype(np.float32) for x in (a, b))
    head, error = max(1, a.shape[1] // HEAD_SHARE), ROUGH * (a.shape[1] + 8)
    rest = [np.sqrt((u[:, head:] ** 2).sum(axis=1)) for u in (ua, ub)]
    low, values, places = low.copy(), np.full((len(a), k), -np.inf), np.full((len(a), k), len(b))
    marks = ub[np.linspace(0, len(b) - 1, min(len(b), MARKS)).astype(int)]
    by_row = np.argsort((ua @ marks.T).argmax(axis=1), kind="stable")
    by_column = np.lexsort((b_gap, (ub @ marks.T).argmax(axis=1), b_cell))
    edges = np.concatenate([[0], np.nonzero(np.diff(b_cell[by_column]))[0] + 1, [len(b)]])
    step, wide = max(1, min(TILE, block_rows)), max(1, block_rows // TILE)
    tiles = [by_column[c:min(c + step, end)] for start, end in zip(edges, edges[1:]) for c in range(start, end, step)]
    middles = np.array([ub[t].mean(axis=0) for t in tiles])
    tile_cell = b_cell[[t[0] for t in tiles]]
    nearest, farthest = (np.array([f(b_gap[t]) for t in tiles]) for f in (np.min, np.max))
    multiplied = 0
    for r0 in range(0, len(a), min(TILE, max(1, chunk_rows))):
        rows = by_row[r0:r0 + min(TILE, max(1, chunk_rows))]
        # The nearest tiles first: they raise the bounds soonest.
        turn = np.argsort(-(middles @ ua[rows].mean(axis=0)), kind="stable")
        at, width, unseen = 0, 1, 0
        while at < len(turn):
            group, some = turn[at:at + width], rows
            at, full = at + width, width >= wide
            width = min(2 * width, wide)
            if a_gaps is not None:
                reach = np.sqrt(np.clip(2.0 - 2.0 * low[some], 0.0, None)) + SLACK
                gap = a_gaps[some][:, tile_cell[group]]
                may = ~(np.maximum(nearest[group] - gap, gap - farthest[group]) > reach[:, None])
                some, group = some[may.any(axis=1)], group[may.any(axis=0)]
                if not len(some):
                    continue
            columns = np.concatenate([tiles[t] for t in group])
            if full and unseen:
                unseen -= 1
            else:
                ceiling = ua[some, :head] @ ub[columns, :head].T + rest[0][some][:, None] * rest[1][columns][None, :]
                may = ceiling >= (low[some] - SLACK - error)[:, None]
                before = len(columns)
                some, columns = some[may.any(axis=1)], columns[may.any(axis=0)]
                unseen = SELDOM if full and 4 * len(columns) > 3 * before else 0
                if not len(some):
                    continue
            multiplied += len(some) * len(columns)
            row, column = np.nonzero(ua[some] @ ub[columns].T >= (low[some] - error)[:, None])
            for part in range(0, len(row), PAIRS_AT_ONCE):
                r, c = some[row[part:part + PAIRS_AT_ONCE]], columns[column[part:part + PAIRS_AT_ONCE]]
                keep = c != own[r]
                r, c = r[keep], c[keep]
                norms = lengths[0][r] * lengths[1][c]
                sims = np.divide(np.einsum("ij,ij->i", a[r], b[c]), norms, out=np.zeros_like(norms), where=norms > 0)
                keep = sims >= low[r]
                _keep_best(values, places, r[keep], c[keep], sims[keep])
                low[some] = np.maximum(low[some], values[some, -1])
    row, at = np.nonzero(places < len(b))
    return row, places[row, at], values[row, at], multiplied


def _chunks(visits: Column, chunk_rows: int, side: int) -> Column:
    """Chunks into which a block's queries are dealt: ``side`` of them, fewer below ``chunk_rows`` each and more above TASK_ROWS."""
    return F.ceil(visits / F.greatest(F.lit(chunk_rows), F.least(F.lit(TASK_ROWS), F.ceil(visits / side)))).cast("int")


def _scan(visits: DataFrame, placed: DataFrame, pivots: np.ndarray, scope: list[str], k: int,
          floor: float | None, exclude_self: bool, block_rows: int, chunk_rows: int, side: int = SIDE) -> DataFrame:
    """k best entries per query and block; both sides of a task are bounded.

    The queries of a block are dealt into chunks of at least ``chunk_rows``, at most ``side`` until a chunk has TASK_ROWS,
    so an entry is copied no more than that. Each task adds one row without a query: how many pairs it had and how many of
    them it multiplied out.
    """
    block_key = [*scope, "block"]
    plan = visits.groupBy(*block_key).agg(F.count(F.lit(1)).alias("_visits")).select(
        *block_key, _chunks(F.col("_visits"), chunk_rows, side).alias("_chunks"))
    if scope:
        dealt = lambda df: join_null_safe(df, plan, block_key)
    else:
        # A row per block, as literals: a join would send the vectors over the network once more.
        known = dict(tuple(r) for r in plan.collect())
        of = F.lit([known.get(i, 0) for i in range(max(known, default=0) + 1)]).cast("array<int>")
        dealt = lambda df: df.withColumn("_chunks", F.get(of, F.col("block"))).filter(F.col("_chunks") > 0)
    left = dealt(visits).select(
        *block_key, F.pmod(F.xxhash64("qid"), F.col("_chunks")).cast("int").alias("_chunk"), "qid", "vec", "reach")
    right = dealt(placed).select(
        *block_key, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "eid", "vec", "cell", "gap")
    keys = [*block_key, "_chunk"]

    def best(q: pa.Table, e: pa.Table) -> pa.Table:
        names = ["qid", "eid", "similarity", "pairs", "multiplied"]
        if not q.num_rows or not e.num_rows:
            return pa.Table.from_arrays([q["qid"].slice(0, 0), e["eid"].slice(0, 0), *[pa.array([], t) for t in (pa.float64(), pa.int64(), pa.int64())]], names=names)
        e = e.sort_by([("eid", "descending")])
        own = np.full(q.num_rows, -1)
        if exclude_self:
            at = {v: i for i, v in enumerate(e["eid"].to_pylist())}
            own = np.array([at.get(v, -1) for v in q["qid"].to_pylist()])
        low = 1.0 - _reach(q["reach"]) ** 2 / 2.0 - SLACK
        if floor is not None:
            low = np.maximum(low, floor)
        a, b = _matrix(q["vec"]), _matrix(e["vec"])
        if a.shape[1] != b.shape[1]:
            raise ValueError(f"vectors must have one number of dimensions, found {[a.shape[1], b.shape[1]]}")
        a, b = _whole(a), _whole(b)
        cells, cell = np.unique(e["cell"].to_numpy(), return_inverse=True)
        gaps = _gaps(a, pivots[cells]) if len(pivots) > 1 else None
        row, column, value, multiplied = _nearest(a, b, min(k, e.num_rows), low, own, gaps, cell, e["gap"].to_numpy(), block_rows, chunk_rows)
        blank = [pa.nulls(len(row), pa.int64())] * 2
        hits = pa.Table.from_arrays([q["qid"].take(pa.array(row)), e["eid"].take(pa.array(column)), pa.array(value), *blank], names=names)
        work = pa.Table.from_arrays([
            pa.nulls(1, q["qid"].type), pa.nulls(1, e["eid"].type), pa.nulls(1, pa.float64()),
            pa.array([q.num_rows * e.num_rows]), pa.array([multiplied])], names=names)
        return pa.concat_tables([hits, work])

    schema = T.StructType([
        T.StructField("qid", visits.schema["qid"].dataType), T.StructField("eid", placed.schema["eid"].dataType),
        T.StructField("similarity", T.DoubleType()), T.StructField("pairs", T.LongType()), T.StructField("multiplied", T.LongType())])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)


def _search(queries: DataFrame, entries: DataFrame, k: int, scope: list[str], min_similarity: float | None, exclude_self: bool,
            pivots: int | None, block_rows: int, chunk_rows: int) -> DataFrame:
    """Candidates of every task, the k best of every query among them, and the rows that count the work."""
    # Columns of their own on both sides, as both may come from the same rows.
    q, e = (df.select(*[F.col(c).alias(c) for c in [*scope, name, "vec"]]) for df, name in ((queries, "qid"), (entries, "eid")))
    if pivots is None:
        pivots = max(1, min(MAX_PIVOTS, entries.count() // block_rows))
    pivot_vectors = _pick_pivots(e, pivots) if pivots > 1 else np.zeros((1, 1))
    several = len(pivot_vectors) > 1
    placed = stored(_with_cells(e, pivot_vectors), "cells") if several else _with_cells(e, pivot_vectors)
    found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("gap").alias("radius"))
    blocks = _Blocks(sorted(tuple(r) for r in found.collect()), block_rows)  # MAX_PIVOTS rows at most
    placed = blocks.place(placed)

    def scan(visits: DataFrame, side: int = SIDE) -> DataFrame:
        return _scan(visits, placed, pivot_vectors, scope, k, min_similarity, exclude_self, block_rows, chunk_rows, side)

    if min_similarity is not None or not several or blocks.count <= 1:
        reach = F.lit(None if min_similarity is None else float(np.sqrt(max(0.0, 2.0 - 2.0 * min_similarity)))).cast("double")
        return scan(_visits(q.withColumn("reach", reach), blocks, pivot_vectors, None))
    # First the blocks of the query's own cell, which bound how far the k-th neighbour can be; then only
    # the blocks that bound cannot rule out. The first round is stored, as both rounds need it.
    first = stored(scan(_visits(q.withColumn("reach", F.lit(None).cast("double")), blocks, pivot_vectors, True), HOME_SIDE), "neighbours")
    kth = top_n(first.filter(F.col("qid").isNotNull()), ["qid"], [F.col("similarity").desc(), F.col("eid").desc()], k).groupBy("qid").agg(
        F.when(F.count(F.lit(1)) == k, F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.min("similarity")))).alias("reach"))
    return first.unionByName(scan(_visits(q.join(kth, "qid", "left"), blocks, pivot_vectors, False)))


def top_k_similar(queries: DataFrame, entries: DataFrame, k: int, scope: Sequence[str] = (),
                  min_similarity: float | None = None, exclude_self: bool = False, pivots: int | None = None,
                  block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The k most similar entries of every query: (qid, eid, similarity, rank), exact.

    ``queries`` has qid, vec and the scope columns, ``entries`` eid, vec and the scope columns; a
    query meets entries of its own scope only. Ties go to the larger id.
    """
    found = _search(queries, entries, k, list(scope), min_similarity, exclude_self, pivots, block_rows, chunk_rows)
    hits = found.filter(F.col("qid").isNotNull()).select("qid", "eid", "similarity")
    return top_n(hits, ["qid"], [F.col("similarity").desc(), F.col("eid").desc()], k, "rank")


def search_work(queries: DataFrame, entries: DataFrame, k: int, scope: Sequence[str] = (),
                min_similarity: float | None = None, exclude_self: bool = False, pivots: int | None = None,
                block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row about that search: pairs brought together in tasks, pairs multiplied out, and their share of all pairs."""
    found = _search(queries, entries, k, list(scope), min_similarity, exclude_self, pivots, block_rows, chunk_rows)
    done = found.filter(F.col("pairs").isNotNull()).agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("multiplied"), F.lit(0)).alias("multiplied"))
    count = lambda df, name: df.groupBy(*scope).agg(F.count(F.lit(1)).alias(name))
    total = join_null_safe(count(queries, "_q"), count(entries, "_e"), list(scope)).agg(F.sum(F.col("_q") * F.col("_e")).alias("_all"))
    one = F.lit(1).alias("_one")
    return done.select("*", one).join(total.select("*", one), "_one").select("pairs", "multiplied", (F.col("multiplied") / F.col("_all")).alias("share"))


def hard_negatives(vectors: DataFrame, k: int = 1, **options: int) -> DataFrame:
    """Directed pairs: every item (slug, vec) with its k most similar different items."""
    found = top_k_similar(
        vectors.select(F.col("slug").alias("qid"), "vec"), vectors.select(F.col("slug").alias("eid"), "vec"),
        k, exclude_self=True, **options)
    return found.select(
        F.concat(F.lit("neg:"), F.col("qid").cast("string"), F.lit("|"), F.col("eid").cast("string")).alias("pair_id"),
        F.col("qid").alias("left_slug"), F.col("eid").alias("right_slug"), F.lit("different").alias("label"),
        F.lit("hard_negative").alias("source"), "similarity", "rank")


def paraphrase_pairs(items: DataFrame, paraphrases: DataFrame, by: str = "slug") -> DataFrame:
    """Each item with its reworded version; items without both embeddings are skipped."""
    left = items.filter(F.col("vec").isNotNull()).select(by, fixed_point(F.col("vec")).alias("_a"))
    right = paraphrases.filter(F.col("vec").isNotNull()).select(by, fixed_point(F.col("vec")).alias("_b"))
    slug = F.col(by).cast("string")
    return left.join(right, by).select(
        F.concat(F.lit("pos:"), slug).alias("pair_id"), F.col(by).alias("left_slug"),
        F.concat(slug, F.lit("#paraphrase")).alias("right_slug"), F.lit("duplicate").alias("label"),
        F.lit("paraphrase").alias("source"), cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def labelled_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    columns = ["pair_id", "label", "similarity"]
    cast = lambda df: df.select(*columns)
    return cast(positives).unionByName(cast(negatives))


def semantic_lookup(queries: DataFrame, entries: DataFrame, threshold: float, now: Column, **options: int) -> DataFrame:
    """Per query the nearest live entry of its model and prompt version, if it is near enough.

    Scope and expiry are applied before the search, so a lapsed or foreign entry cannot be served.
    """
    scope = ["model", "prompt_version"]
    live = entries.filter(F.col("expires_at") > now).select(*scope, F.col("entry_id").alias("eid"), "vec")
    asked = queries.select(*scope, F.col("query_id").alias("qid"), "vec")
    found = top_k_similar(asked, live, 1, scope, threshold, **options)
    hits = found.select(F.col("qid").alias("query_id"), F.col("eid").alias("entry_id"), "similarity")
    return queries.select("query_id", *scope).join(hits, "query_id", "left").withColumn("hit", F.col("entry_id").isNotNull())


def nearest_route(vectors: DataFrame, centroids: DataFrame, threshold: float, safe_default: str) -> DataFrame:
    """Route of the nearest centroid; below the threshold the item is out of distribution."""
    found = top_k_similar(
        vectors.select(F.col("slug").alias("qid"), "vec"),
        centroids.select(F.col("route_key").alias("eid"), F.col("centroid").alias("vec")), 1)
    assigned = centroids.select(F.col("route_key").alias("eid"), "assigned_model")
    near = F.col("similarity") >= threshold
    return found.join(assigned, "eid").select(
        F.col("qid").alias("slug"), F.when(near, F.col("eid")).alias("route_key"), "similarity",
        F.when(near, F.col("assigned_model")).otherwise(F.lit(safe_default)).alias("model_served"),
        F.when(near, F.lit("nearest_route")).otherwise(F.lit("out_of_distribution")).alias("reason"))


def _cluster_parts(vectors: DataFrame, centres: dict[int, np.ndarray], width: int) -> DataFrame:
    """Sums for every set of centres: (k, cluster, task_type, n, closeness, sums), a few rows from each task.

    A row goes to its nearest centre, of equally near ones to the first. ``closeness`` is the sum of
    (other - own) / max(other, own) over the distances to the own and the next nearest centre, as whole
    numbers of 2^-30. All sums are whole numbers, so the order of rows has no part in them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, str | None], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("vec"))
            if rows.shape[1] != width:
                raise ValueError(f"vectors must have one number of dimensions, found {rows.shape[1]} and {width}")
            squares = (rows * rows).sum(axis=1)
            if squares.max() >= EXACT_SQUARE:
                raise ValueError("a vector is too long for exact distances; give unit vectors")
            tasks, task = np.unique(np.array(["" if t is None else "t" + t for t in batch.column("task_type").to_pylist()], dtype=object), return_inverse=True)
            for k, centre in centres.items():
                apart = squares[:, None] - 2.0 * (rows @ centre.T) + (centre * centre).sum(axis=1)[None, :]
                own = apart.argmin(axis=1)
                near = np.sqrt(np.sort(apart, axis=1)[:, :2])
                far = near[:, 1]
                close = np.divide(far - near[:, 0], far, out=np.zeros_like(far), where=far > 0)
                units = np.floor(close * CLOSENESS + 0.5).astype(np.int64)
                for c, t in {*zip(own.tolist(), task.tolist())}:
                    here = (own == c) & (task == t)
                    held = sums.setdefault((k, c, tasks[t][1:] if tasks[t] else None), [0, 0, np.zeros(width, np.int64)])
                    held[0] += int(here.sum())
                    held[1] += int(units[here].sum())
                    held[2] += rows[here].astype(np.int64).sum(axis=0)
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in keys], pa.int32()), pa.array([c for _, c, _ in keys], pa.int32()),
                pa.array([t for _, _, t in keys], pa.string()), pa.array([sums[x][0] for x in keys], pa.int64()),
                pa.array([sums[x][1] for x in keys], pa.int64()), pa.array([sums[x][2].tolist() for x in keys], pa.list_(pa.int64())),
            ], names=["k", "cluster", "task_type", "n", "closeness", "sums"])

    return vectors.select("task_type", "vec").mapInArrow(
        run, "k int, cluster int, task_type string, n bigint, closeness bigint, sums array<bigint>")


def _spread(pool: np.ndarray, k: int) -> np.ndarray:
    """The first vector, then k - 1 times the one farthest from all taken; of equally far ones the first."""
    taken, nearest = [0], np.full(len(pool), np.inf)
    while len(taken) < k:
        last = pool[taken[-1]]
        nearest = np.minimum(nearest, (pool * pool).sum(axis=1) - 2.0 * (pool @ last) + (last * last).sum())
        taken.append(int(nearest.argmax()))
    return pool[taken]


def _moved(parts: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The mean of every cluster, to whole numbers; a cluster without rows keeps its centre."""
    placed = parts.select("k", "cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("k", "cluster", "i").agg(
        F.floor(F.sum("x").cast("double") / F.sum("n").cast("double") + 0.5).cast("double").alias("x"))
    out = {k: centre.copy() for k, centre in centres.items()}
    for r in placed.collect():  # as many numbers as the centres have
        out[r["k"]][r["cluster"], r["i"]] = r["x"]
    return out


def discover_routes(vectors: DataFrame, k_range: Sequence[int], seed: int = 1, rounds: int = 20) -> DataFrame:
    """Cluster items by k-means; the k with the highest simplified silhouette wins. One row per route.

    ``vectors`` has slug, vec and task_type, and split if there are several: routes are learned from the
    rows of ``calibration`` and ``dev``, and a table that holds an item on both sides is refused. Without a
    split column all rows are taken for training rows. The start centres are spread out over the DRAWN * k
    different vectors whose items have the smallest hashes: the first of them, then always the one that is
    farthest from those taken. Every round reads the rows once for all k, until no centre moves or
    ``rounds`` are done. Vectors and centres are whole numbers of 2^-24, distances and sums are exact, so
    neither the partitioning nor a lost task changes a digit. Of equal silhouettes the smaller k wins. The
    task of a route is its most frequent one, of equally frequent ones the last by name. Rows without a
    vector are skipped; fewer distinct vectors than the largest k, or none, are refused.
    """
    ks = sorted(set(k_range))
    if not ks or ks[0] < 2:
        raise ValueError("at least two routes are needed")
    if "split" in vectors.columns:
        require_one_split(vectors.select("slug", "split"))
        vectors = vectors.filter(F.col("split").isin(*TRAINING_SPLITS))
    train = stored(vectors.filter(F.col("vec").isNotNull()).select(
        "slug", F.col("task_type").cast("string").alias("task_type"), fixed_point(F.col("vec")).alias("vec")), "routes")
    # A bounded draw of different vectors; a vector that several items share counts once.
    drawn = F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col("slug").cast("string"))).alias("h"), F.col("slug").cast("string").alias("s"))
    pool = [r["vec"] for r in train.groupBy("vec").agg(F.min(drawn).alias("_at")).orderBy("_at").limit(DRAWN * ks[-1]).collect()]
    if len(pool) < ks[-1]:
        raise ValueError(f"{ks[-1]} routes need as many different vectors, found {len(pool)}")
    starts = _spread(np.array(pool, dtype=float), ks[-1])
    width = starts.shape[1]
    centres = {k: starts[:k] for k in ks}
    moving = dict(centres)
    for _ in range(rounds):
        after = _moved(_cluster_parts(train, moving, width), moving)
        centres.update(after)
        moving = {k: c for k, c in after.items() if not np.array_equal(c, moving[k])}
        if not moving:
            break
    spark = train.sparkSession
    parts = stored(_cluster_parts(train, centres, width).drop("sums"), "route-parts")
    scores = {r["k"]: r["s"] for r in parts.groupBy("k").agg((F.sum("closeness") / F.lit(CLOSENESS) / F.sum("n")).alias("s")).collect()}
    best = max(ks, key=lambda k: (scores[k], -k))
    middle = spark.createDataFrame([(i, [float(x) / SCALE for x in c]) for i, c in enumerate(centres[best])], "cluster int, centroid array<double>")
    tasks = parts.filter(F.col("k") == best).groupBy("cluster", "task_type").agg(F.sum("n").alias("n"))
    routes = tasks.groupBy("cluster").agg(F.sum("n").alias("n_items"), F.max(F.struct("n", "task_type"))["task_type"].alias("task_type"))
    return routes.join(middle, "cluster").select(
        F.format_string("route-%02d", "cluster").alias("route_key"), "task_type", "n_items", "centroid", F.lit(float(scores[best])).alias("silhouette"))


# ---- cache calibration --------------------------------------------------------------------

def threshold_counts(pairs: DataFrame, grid: Sequence[float] = CACHE_GRID, by: Sequence[str] = ()) -> DataFrame:
    """Hits among duplicates and among different pairs at every threshold, from one pass."""
    buckets = pairs.filter(F.col("similarity").isNotNull()).groupBy(
        *by, grid_bucket(F.col("similarity"), grid).alias("bucket")).agg(
        F.count_if(F.col("label") == "duplicate").alias("dup"), F.count_if(F.col("label") == "different").alias("diff"))
    hit = ~F.col("below")
    return at_thresholds(buckets, grid, by).groupBy(*by, "threshold").agg(
        F.sum("dup").alias("n_duplicates"), F.sum(F.when(hit, F.col("dup")).otherwise(0)).alias("duplicate_hits"),
        F.sum("diff").alias("n_different"), F.sum(F.when(hit, F.col("diff")).otherwise(0)).alias("false_hits"))


def calibrate_threshold(pairs: DataFrame, grid: Sequence[float] = CACHE_GRID, by: Sequence[str] = (),
                        tolerance: float = MAX_FALSE_HIT_RATE, alpha: float = stats.ALPHA,
                        resamples: int = stats.POLICY_RESAMPLES) -> DataFrame:
    """Hit rate and false-hit rate with bounds; acceptable only by the false hits' upper bound."""
    counts = threshold_counts(pairs, grid, by)
    both = F.when((F.col("n_duplicates") == 0) | (F.col("n_different") == 0),
                  F.raise_error(F.lit("calibration needs duplicates and different pairs")).cast("double"))
    dup, diff = F.col("n_duplicates"), F.col("n_different")
    bounded = counts.withColumn("_hit", stats.rate_interval(F.col("duplicate_hits"), dup, alpha, resamples)).withColumn(
        "_false", stats.exact_bounds(F.col("false_hits"), diff, alpha))
    return bounded.select(
        *by, "threshold", F.coalesce(both, F.col("duplicate_hits") / dup).alias("hit_rate"),
        (F.col("_hit.low") / dup).alias("hit_ci_low"), (F.col("_hit.high") / dup).alias("hit_ci_high"), "n_duplicates",
        (F.col("false_hits") / diff).alias("false_hit_rate"), F.col("_false.low").alias("false_hit_ci_low"),
        F.col("_false.high").alias("false_hit_ci_high"), "n_different",
        (F.col("_false.high") <= tolerance).alias("acceptable"),
        (F.lit(1.0) - F.col("duplicate_hits") / dup).alias("miss_rate"))


def evidence_gap(curve: DataFrame, tolerance: float = MAX_FALSE_HIT_RATE, by: Sequence[str] = ()) -> DataFrame:
    """Different pairs needed to prove the tolerance with no false hit, against those there are."""
    needed = stats.min_trials(F.lit(tolerance))
    return curve.groupBy(*by).agg(F.max("n_different").alias("n_different")).select(
        *by, "n_different", needed.alias("required"),
        F.greatest(F.lit(0), needed - F.col("n_different")).alias("shortfall"))


def chosen_threshold(curve: DataFrame, by: Sequence[str] = (), min_hit_rate: float = MIN_HIT_RATE,
                     tolerance: float = MAX_FALSE_HIT_RATE) -> DataFrame:
    """Best hit rate among safe and useful thresholds, or the reason there is none."""
    usable = F.col("acceptable") & (F.col("hit_rate") >= min_hit_rate)
    pick = F.struct("threshold", "hit_rate", "false_hit_rate", "false_hit_ci_high")
    best = F.max_by(F.when(usable, pick), F.when(usable, F.struct(F.col("hit_rate"), -F.col("threshold"))))
    summary = curve.groupBy(*by).agg(
        best.alias("_best"), F.max("n_different").alias("n_different"),
        F.count_if(F.col("acceptable")).alias("safe_points"), F.max("n_duplicates").alias("n_duplicates"))
    return summary.select(
        *by, "n_duplicates", "n_different", "safe_points", F.col("_best.threshold").alias("threshold"),
        F.col("_best.hit_rate").alias("hit_rate"), F.col("_best.false_hit_rate").alias("false_hit_rate"),
        F.col("_best.false_hit_ci_high").alias("false_hit_ci_high"),
        F.when(F.col("_best").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("n_different") < stats.min_trials(F.lit(tolerance)), F.lit("sample_size"))
        .when(F.col("safe_points") > 0, F.lit("safe_not_useful")).otherwise(F.lit("none_safe")).alias("refusal"))


def price_of_usefulness(curve: DataFrame, by: Sequence[str] = (), min_hit_rate: float = MIN_HIT_RATE) -> DataFrame:
    """Best hit rate each tolerance would buy; zeros where none does. Ties keep the first grid point."""
    listed = curve.select("*", F.explode(F.array(*[F.lit(t) for t in TOLERANCES])).alias("tolerance"))
    usable = (F.col("false_hit_ci_high") <= F.col("tolerance")) & (F.col("hit_rate") >= min_hit_rate)
    pick = F.struct("hit_rate", "threshold")
    best = F.max_by(F.when(usable, pick), F.when(usable, F.struct(F.col("hit_rate"), -F.col("threshold"))))
    return listed.groupBy(*by, "tolerance").agg(best.alias("_best")).select(
        *by, "tolerance", F.coalesce("_best.hit_rate", F.lit(0.0)).alias("hit_rate"),
        F.coalesce("_best.threshold", F.lit(0.0)).alias("threshold"))
