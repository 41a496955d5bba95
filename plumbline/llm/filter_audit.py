"""How five filters act together, in every order: which documents each removes, which it would have removed alone.

Words become a sparse document-term matrix. Tasks cut their texts into shards of bounded bytes and write each as CSR
(row ends, steps from one word number of the shard to the next, counts) with the shard's own distinct words, ordered by hash. Ranges of the hash
then meet shard after shard in one task each, which numbers their distinct words; the numbers go back as one packed row
per shard and range. The rows of the matrix give what filters A and B ask for: a row's sum is its words, its nonzeros
are its distinct words. The other filters are attached as flags. What is left of a document is then one of 32 sets of
failed filters, and all 120 orders are sums over the counts of these sets.

Odd rows: a null text is the empty one and a null lang the part ''. Rows that share an id are documents of their own;
E compares ids, so equal texts of one id are no copies of each other, and a row without an id neither is nor has a
smaller one. An id with several labels counts with the largest of each. An empty table has no parts, hence no rows.
One text longer than a shard is a shard of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import encoded, slices, stored

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"
SHARD_BYTES = 8 << 20
#: Ranges of the words' hash; as many of them are joined as hold ``RANGE_WORDS`` words of all shards, whose distinct ones a task numbers.
_FINE, RANGE_WORDS = 4096, 1_000_000

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

SHARDS = "shard long, doc_id array<{kind}>, part array<string>, digest array<binary>, flags array<int>, ends binary, columns binary, counts binary, width int"


def _kind(docs: DataFrame) -> str:
    """Type of the ids, which are compared as what they are."""
    return docs.schema["doc_id"].dataType.simpleString()


def text_flags(text: bytes) -> int:
    """Filters C and D of one text, as bits 2 and 3."""
    b = np.frombuffer(text, np.uint8)
    points = len(b) - int(((b & 0xC0) == 0x80).sum())
    return 4 * (100 * int(_UPPER[b].sum()) > UPPER_PERCENT * points) + 8 * bool(_SYMBOL[b].any())


def matrix_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Row ends, columns and counts of the texts' words, the words the columns stand for, and where ranges of their hash begin.

    ``bytes.split`` cuts at the six ASCII white-space characters, which are the only ones that end a word.
    """
    tokens, lengths = [], []
    for text in texts:
        words = text.split()
        tokens += words
        lengths.append(len(words))
    if not tokens:
        none = np.zeros(0, np.int64)
        return np.zeros(len(texts), np.int64), none, none, [], np.zeros(_FINE + 1, np.int64)
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    codes = place[coded.indices.to_numpy(zero_copy_only=False)]
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    cells = np.sort(rows << 32 | codes)
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    counts = np.diff(np.append(first, len(cells)))
    cells = cells[first]
    ends = np.searchsorted(cells >> 32, np.arange(len(texts)), side="right")
    cuts = np.searchsorted(hashes[order] >> 20, np.arange(_FINE + 1))
    return ends, cells & 0xFFFFFFFF, counts, [words[i] for i in order.tolist()], cuts


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in as few bytes as the largest needs."""
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def local_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """CSR shards whose columns are numbers of the shard's own words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                texts = [encoded(t) for t in part.column("text").to_pylist()]
                ends, columns, counts, words, cuts = matrix_rows(texts)
                counts = _narrow(counts)
                digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
                whole = lambda column: pa.ListArray.from_arrays([0, len(texts)], column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + k]), whole(part.column("doc_id")), whole(part.column("part")), whole(pa.array(digests, pa.binary())),
                     whole(pa.array([text_flags(t) for t in texts], pa.int32())), pa.array([ends.astype("<i4").tobytes()]),
                     pa.array([np.diff(columns, prepend=0).astype("<i4").tobytes()]), pa.array([counts.tobytes()]), pa.array([counts.itemsize], pa.int32()),
                     pa.array([b" ".join(words)]), pa.array([cuts.astype("<i4").tobytes()]), pa.array([len(words)])],
                    names=["shard", "doc_id", "part", "digest", "flags", "ends", "columns", "counts", "width", "words", "cuts", "n_words"])
                k += 1

    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return stored(texts.mapInArrow(cut, SHARDS.format(kind=_kind(docs)) + ", words binary, cuts binary, n_words long"), "audit-shards", compression="zstd")


def numbered_words(local: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """(range, shard, numbers, words, n): each shard's words of a range as numbers, in the order of the shard's columns.

    A row without a shard holds the ``n`` distinct words of the range in the order of their numbers. A word holds no
    white space, so a space between words is enough to tell them apart.
    """
    held = local.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(1, min(_FINE, -(-held // range_words)))
    edges = np.arange(ranges + 1) * _FINE // ranges

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, cuts in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "cuts"))):
                words, at = words.split(b" ") if words else [], np.frombuffer(cuts, "<i4")[edges].tolist()
                out = [(r, b" ".join(words[a:b])) for r, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in out], pa.int32()), pa.array([shard] * len(out), pa.int64()), pa.array([w for _, w in out], pa.binary())],
                    names=["range", "shard", "words"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "shard", "numbers", "words", "n"]

        def row(shard, numbers, words, n):
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([shard], pa.int64()), pa.array([numbers], pa.binary()),
                                               pa.array([words], pa.binary()), pa.array([n], pa.int64())], names=names)

        now, known = None, {}
        for batch in batches:
            for part, shard, words in zip(*(batch.column(c).to_pylist() for c in ("range", "shard", "words"))):
                if part != now:
                    if known:
                        yield row(None, None, b" ".join(known), len(known))
                    now, known = part, defaultdict(itertools.count().__next__)
                ids = np.fromiter(map(known.__getitem__, words.split(b" ")), "<i4")
                yield row(shard, ids.tobytes(), None, len(ids))
        if known:
            yield row(None, None, b" ".join(known), len(known))

    dealt = local.select("shard", "words", "cuts").mapInArrow(deal, "range int, shard long, words binary")
    sorted_ = dealt.repartition("range").sortWithinPartitions("range", "shard")
    return stored(sorted_.mapInArrow(number, "range int, shard long, numbers binary, words binary, n long"), "audit-numbers", compression="zstd")


def term_matrix(docs: DataFrame, shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """The CSR shards with columns numbered over all documents (64 bits each), and the dictionary (first number, words)."""
    local = local_shards(docs, shard_bytes)
    numbers = numbered_words(local, range_words)
    sizes = dict(numbers.filter(F.col("shard").isNull()).select("range", "n").collect())  # at most one row for each of 4,096 ranges
    starts = dict(zip(sorted(sizes), itertools.accumulate([0, *(sizes[r] for r in sorted(sizes))])))
    known = numbers.filter(F.col("shard").isNotNull()).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("range", "numbers"))).alias("known"))

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                table = np.concatenate([np.zeros(0, np.int64), *(starts[k["range"]] + np.frombuffer(k["numbers"], "<i4").astype(np.int64) for k in row.column("known")[0].as_py() or [])])
                columns = table[np.cumsum(np.frombuffer(row.column("columns")[0].as_py(), "<i4"), dtype=np.int64)]
                cut = [row.column(f) if f != "columns" else pa.array([columns.astype("<i8").tobytes()]) for f in kept]
                yield pa.RecordBatch.from_arrays(cut, names=list(kept))

    kept = ("shard", "doc_id", "part", "digest", "flags", "ends", "columns", "counts", "width")
    joined = local.select(*kept).join(known, "shard", "left")
    first = F.create_map(*[F.lit(x) for r, n in starts.items() for x in (r, n)])[F.col("range")] if starts else F.lit(0)
    dictionary = numbers.filter(F.col("shard").isNull()).select(first.cast("long").alias("first"), "words")
    return joined.mapInArrow(renumber, SHARDS.format(kind=_kind(docs))), dictionary


def row_flags(shards: DataFrame) -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, failed): bits 0 to 3 of ``failed`` are filters A to D."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends = np.frombuffer(batch.column("ends")[i].as_py(), "<i4").astype(np.int64)
                sums = np.concatenate(([0], np.cumsum(np.frombuffer(batch.column("counts")[i].as_py(), f"<u{batch.column('width')[i].as_py()}").astype(np.int64))))
                starts = np.concatenate(([0], ends[:-1]))
                n_words, n_distinct = sums[ends] - sums[starts], ends - starts
                failed = (n_words < LEAST_WORDS) + 2 * (100 * n_distinct < DISTINCT_PERCENT * n_words) + batch.column("flags")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i].values, batch.column("part")[i].values, batch.column("digest")[i].values,
                     pa.array(n_words), pa.array(n_distinct), pa.array(failed, pa.int32())],
                    names=["doc_id", "part", "digest", "n_words", "n_distinct", "failed"])

    kind = shards.schema["doc_id"].dataType.elementType.simpleString()
    return shards.mapInArrow(measure, f"doc_id {kind}, part string, digest binary, n_words long, n_distinct long, failed int")


def failures(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``row_flags`` of all documents with bit 4, filter E."""
    rows = stored(row_flags(term_matrix(docs, shard_bytes)[0]), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(firsts, "digest", "left").withColumn("failed", F.col("failed") + 16 * later).drop("first", "digest")


def label_flags(labels: DataFrame) -> DataFrame:
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    return marked.filter("good = 1 OR toxic = 1")


def interactions(failed: DataFrame) -> DataFrame:
    """Counts per part, order and step from (part, failed, good, toxic) rows."""
    sets = failed.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = sets.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bits = F.transform(F.split("filter_order", ""), lambda letter: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(FILTERS), letter) - 1))
    steps = steps.withColumn("_bits", bits).withColumn("_mine", F.element_at("_bits", F.col("step")))
    steps = steps.withColumn("_earlier", F.aggregate(F.slice("_bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    fails = F.col("failed").bitwiseAND(F.col("_mine")) != 0
    gone = F.col("failed").bitwiseAND(F.col("_earlier")) != 0
    count = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")
    # Of the 120 orders, one in as many as the failed filters puts this one first.
    share = F.when(fails, F.col("n") * F.expr("120 div bit_count(failed)")).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("failed") == F.col("_mine")).alias("unique_fails"), count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The report: one row per part, order of the filters and step."""
    marked = failures(docs, shard_bytes).join(label_flags(labels), F.col("doc_id") == F.col("_id"), "left")
    return interactions(marked.select("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
