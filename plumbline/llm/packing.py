"""Best-fit packing of documents into token sequences, bulk-synchronous.

Tokens of a document are its ids and an end id. Only documents longer than a sequence are cut: the first piece
takes what is over, the others fill a sequence each. Pieces are ordered by length and ranked inside each length
by distributed slices; gaps are ordered and ranked alike. A round sweeps down the lengths: every piece is matched
with its successor, the smallest gap that holds it; pieces that want the same gap are served by rank, the n-th
piece of the run taking the n-th gap; and the gaps are updated for the next round, which begins where a piece
needs a gap of this round, or a new sequence. Pieces of one length and gaps of one size differ only in rank, so
a match is a run (length, ranks, gap, ranks): the sweeps work on counts per length, at most ``capacity`` numbers
however many documents there are, and each piece finds its place from the runs by its own length and rank.

Inputs: a null text is empty and gives one piece, the end id. Rows that repeat an id are packed each. Null ids
are kept. Extra columns are ignored. No documents give no sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import slices, stored, tidy
from plumbline.llm.encoding import default_path, encoder

CAPACITY = 1024
END_ID = 2
SLICE_ROWS = 200_000
_RANKS = 1 << 50


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; texts are encoded where they lie."""
    path, end = path or default_path(), np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                rows: list[tuple[int, int, int, int]] = []
                owners: list[int] = []
                for i, ids in enumerate(encoder(path).ids([t or "" for t in cut.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    lengths = [(n - 1) % capacity + 1] + [capacity] * ((n - 1) // capacity)
                    at = 0
                    for k, length in enumerate(lengths):
                        rows.append((k, at, length, zlib.crc32(ids[at * 4: (at + length) * 4])))
                        at += length
                    owners += [i] * len(lengths)
                piece, start, length, crc = zip(*rows)
                yield pa.record_batch([
                    cut.column(0).take(pa.array(owners, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs of matches: pieces (size, rank...) to gaps (gap, rank...) or new sequences, in rounds."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences, self.rounds = capacity, 0, 0
        self.runs: list[tuple[int, int, int, int, int, int, int]] = []  # size, rank, pieces, gap, gap rank, new gap, its rank
        self._made = [0] * (capacity + 1)  # gaps of each size so far
        self._used = [0] * (capacity + 1)
        left = dict(counts)
        taken = dict.fromkeys(left, 0)
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        at = 0
        while at < len(sizes):
            self.rounds += 1
            free = {g: self._made[g] - self._used[g] for g in range(1, capacity + 1) if self._made[g] > self._used[g]}
            order = sorted(free)
            newest = 0  # largest gap made in this round
            while at < len(sizes):
                s = sizes[at]
                k = bisect.bisect_left(order, s)
                while left[s] and k < len(order):
                    n = min(left[s], free[order[k]])
                    newest = max(newest, self._match(s, taken, left, n, order[k]))
                    free[order[k]] -= n
                    if free[order[k]]:
                        break
                    del order[k]
                if left[s] and newest < s:
                    newest = max(newest, self._match(s, taken, left, -(-left[s] // (capacity // s)), 0))
                if left[s]:
                    break
                at += 1
        size, rank, n, gap, gap_rank, out, out_rank = (np.array(c, np.int64) for c in (zip(*self.runs) if self.runs else [()] * 7))
        by_piece, by_gap = np.argsort(size * _RANKS + rank), np.argsort(out * _RANKS + out_rank)
        self._piece_keys, self._gap_keys = (size * _RANKS + rank)[by_piece], (out * _RANKS + out_rank)[by_gap]
        self._piece = np.stack([rank, gap, gap_rank], axis=1)[by_piece]
        self._gap = np.stack([out_rank, gap, gap_rank], axis=1)[by_gap]

    def _match(self, s: int, taken: dict[int, int], left: dict[int, int], n: int, gap: int) -> int:
        """n pieces of size s into n gaps, or into n new sequences for gap 0; returns the size of the gaps that remain."""
        new = (gap or self.capacity) - s
        first = self._used[gap] if gap else self.sequences
        self.runs.append((s, taken[s], n, gap, first, new, self._made[new]))
        if gap:
            self._used[gap] += n
        else:
            self.sequences += n
        self._made[new] += n
        taken[s] += n
        left[s] -= n
        return new

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by size and rank: their own run, then back through the gaps to the first piece."""
        run = self._piece[np.searchsorted(self._piece_keys, size * _RANKS + rank, "right") - 1]
        gap, number = run[:, 1].copy(), run[:, 2] + rank - run[:, 0]
        offset = np.where(gap > 0, self.capacity - gap, 0)
        while (open_ := np.nonzero(gap > 0)[0]).size:
            made = self._gap[np.searchsorted(self._gap_keys, gap[open_] * _RANKS + number[open_], "right") - 1]
            number[open_] = made[:, 2] + number[open_] - made[:, 0]
            gap[open_] = made[:, 1]
        return number, offset


def ranked(found: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds a gapless rank inside each length; slices dealt by hash keep a frequent length from meeting in one task."""
    biggest = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    width = max(8, -(-biggest // slice_rows))
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)))
    sizes = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))
    return sliced.withColumn("own", own).join(offsets, ["length", "slice"]).withColumn("rank", (F.col("before") + F.col("own") - 1).cast("long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; see the module's text for odd rows."""
    found = stored(pieces(docs, capacity, path), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = Plan(counts, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5)))
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked(found, slice_rows).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
