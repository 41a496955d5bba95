"""SimHash near-duplicates: fingerprints of word shingles, compared by vertical bit planes.

Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked. Distinct fingerprints meet when two of
five bit fields agree (three differing bits leave at least two fields untouched), so every link is found in
one of ten tables. Inside a table the rows of a bucket are compared bit-sliced: the 64 bits of up to thousands
of fingerprints are stored as 64 planes, a query is XORed plane by plane, carry-save counters hold the distances
of 64 rows per machine word, and a block is left as soon as every row has passed the radius. A block yields a
spanning forest of its links, never all its pairs, and a bucket larger than a block is cut into block pairs.

Inputs: null texts and texts without words have the fingerprint zero and are linked like any other. Rows that
repeat an id are each a row of the result. A null ``doc_id`` keeps its row; its component is the smallest id
of its group, null when the group has none. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import components
from plumbline.llm.common import LOWER_BYTES, encoded, free_names, slices, stored, tidy

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Five fields of the fingerprint as (shift, width); a bucket is a pair of fields.
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple((a, b) for a in range(len(FIELDS)) for b in range(a + 1, len(FIELDS)))
#: Rows of a comparison block; a larger bucket becomes pairs of blocks.
BLOCK = 4096
QUERIES = 128

_SHIFTS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None) -> list[int]:
    words = encoded(text).translate(LOWER_BYTES).split()
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1:] - 1).tolist())]


def fingerprint(text: str | None) -> int:
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65536):
        bits = np.unpackbits(h[lo: lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """One row (doc_id, fp, digest) per document; fp is the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                fps = np.array([fingerprint(t) for t in cut.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.record_batch([cut.column(0), pa.array(fps, pa.int64()), cut.column(2)], names=["doc_id", "fp", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.lit(None) if digest is None else digest).cast("long").alias("digest")).mapInArrow(
        tidy(run), "doc_id long, fp long, digest long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit j of row i says whether fingerprint j has bit i set."""
    width = -(-len(fps) // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, : len(fps)] = ((fps[None, :] >> _SHIFTS[:, None]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def close_pairs(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query index, row index) of all fingerprints within ``radius`` (0 to 3) bits, by carry-save counters."""
    planes, found = planes_of(fps), []
    spare = np.full(planes.shape[1], ~np.uint64(0))
    if len(fps) % 64:
        spare[-1] = np.uint64((1 << (len(fps) % 64)) - 1)
    full = ~np.uint64(0)
    for lo in range(0, len(queries), QUERIES):
        q = queries[lo: lo + QUERIES]
        masks = np.where((q[:, None] >> _SHIFTS[None, :]) & np.uint64(1), full, np.uint64(0))
        ones = np.zeros((len(q), planes.shape[1]), np.uint64)
        twos, over = ones.copy(), np.broadcast_to(~spare, ones.shape).copy()
        for i in range(64):
            carry = planes[i][None, :] ^ masks[:, i: i + 1]
            fresh = ones & carry
            ones ^= carry
            over |= twos & fresh
            twos ^= fresh
            if i % 8 == 7 and (over == full).all():
                break
        else:
            if radius < 3:  # the two counter bits hold 0 to 3
                over |= twos & ones if radius == 2 else twos if radius == 1 else twos | ones
            within = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            a, b = np.nonzero(within)
            found.append((a + lo, b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member of its component) that span the given links; vectorised label passing."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        np.minimum.at(fresh, left, low)
        np.minimum.at(fresh, right, low)
        np.minimum.at(fresh, label[left], low)
        np.minimum.at(fresh, label[right], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    member = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[member], fps[label[member]]


def _block_links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each task (t, k, i, j), whose rows follow one another.

    Small buckets are compared together as one block: any two fingerprints within the radius are a link,
    whichever bucket brought them together.
    """
    held: list[np.ndarray] = []
    size = 0

    def emit(fps: np.ndarray) -> pa.RecordBatch:
        fps = np.unique(fps)
        a, b = close_pairs(fps, fps)
        keep = a < b
        one, two = _forest(fps, a[keep], b[keep])
        return pa.record_batch([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["a", "b"])

    last = None
    for batch in rows:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(fps):
            continue
        cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        edges = [0, *cuts.tolist(), len(fps)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = tuple(keys[lo])
            if key != last and size >= QUERIES * 4:
                yield emit(np.concatenate(held))
                held, size = [], 0
            held.append(fps[lo:hi])
            size += hi - lo
            last = key
    if held:
        yield emit(np.concatenate(held))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within the radius."""
    def field(n: int):
        shift, width = FIELDS[n]
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    tables = [F.struct(F.lit(n).alias("t"), (F.shiftleft(field(a), 13) + field(b)).alias("k")) for n, (a, b) in enumerate(PAIRS)]
    members = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("x.t", "x.k", "fp")
    sizes = members.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o")
    tasks = (members.join(sizes, ["t", "k"]).withColumn("c", chunks)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
             .select("t", "k", "fp", "own", other)
             .select("t", "k", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "fp"))
    dealt = tasks.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.select(F.col("t").cast("long"), F.col("k").cast("long"), F.col("i").cast("long"), F.col("j").cast("long"), "fp").mapInArrow(
        tidy(_block_links), "a long, b long").distinct()


def hex16(fp: str):
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every document; see the module's text for odd rows."""
    prints = stored(fingerprints(docs), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    edges = stored(links(classes.select("fp"), block), "links")
    label = components.smallest_reachable(edges, classes)
    # Only fingerprints with a link or a copy differ from their own id; hot ones are split as a skewed join.
    return prints.join(label, "fp", "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest id, of several by a digest of the row.

    Groups are named by fingerprints, as texts without anything in common may share an id. Rows without an id come
    behind those with one. Only numbers are grouped. The texts move once, to meet the rows that stay, and again only
    where equal rows repeat. The rows that stay grow with the corpus, so the join is a merge join at every size."""
    digest = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    prints = stored(fingerprints(docs, digest), "simhash")
    classes = stored(prints.select("fp", F.col("fp").alias("first_id")).distinct(), "classes")
    label = components.smallest_reachable(stored(links(classes.select("fp"), block), "links"), classes)
    grouped = prints.join(label, "fp", "left").groupBy(F.coalesce("component", "fp").alias("group"), "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest", "n")).alias("m")
    chosen = stored(grouped.groupBy("group").agg(first).select("m.doc_id", "m.digest", "m.n"), "chosen")
    mark, kept_id, kept_digest = free_names(docs, "_digest", "_kept_id", "_kept_digest")
    keys = chosen.select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest)).hint("merge")
    marked = docs.withColumn(mark, digest)
    kept = marked.join(keys, (F.col(mark) == F.col(kept_digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    if not chosen.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)
