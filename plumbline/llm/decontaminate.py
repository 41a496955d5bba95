"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Every window of an item is a set of shingles that must be contained whole, so by the prefix principle one
shingle, the rarest of the window in the corpus, must occur in any document that holds the window. Documents
are joined on these prefix shingles only. A candidate must leave room for the window before and behind the
shingle (positional and length bounds), and then the window's words are compared one by one.

A benchmark's index has a row per distinct window. It is broadcast only in blocks of ``BLOCK_ROWS`` rows, whose
size is thereby bounded; a larger benchmark takes one pass over the documents per block.

Inputs: null texts have no words. Each row of ``documents`` is judged by itself, also when ids repeat or are
null. Items that repeat an id are separate texts of one item; items without words or id are no item. Extra
columns are ignored. Without items, or without documents, the result has no hits or no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import LOWER, UPPER, free_names, stored

#: Everything in ASCII that is neither a digit nor a lower-case letter; applied after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: Rows of the index in one broadcast; at 13 words of 100 bytes and some numbers this is below 100 MB.
BLOCK_ROWS = 60_000
#: A document is contaminated when a twentieth of its words or more is hit.
SHARE = 20


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _shingle_hash(z: str, k: int) -> Column:
    return F.xxhash64(*[F.col(f"{z}.w{i}") for i in range(k)])


def _zipped(words: str) -> Column:
    n = F.size(words)
    parts = [F.col(words).alias("w0")] + [F.slice(words, i + 1, F.greatest(n, F.lit(1))).alias(f"w{i}") for i in range(1, SHINGLE)]
    return F.arrays_zip(*parts)


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window): the distinct word windows of each item; a shorter item is one window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    words = words.filter(F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.slice("w", F.col("at"), window).alias("window")).distinct()


def _positions(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, w, pos, z) for each word; a first row with pos -1 stands for the document itself."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), words_of(F.col("text")).alias("w"))
    zipped = base.select("row", "doc_id", "w", F.size("w").alias("n_words"), _zipped("w").alias("zs"))
    return zipped.select("row", "doc_id", "w", "n_words", F.posexplode_outer("zs").alias("pos", "z"))


def rarest_shingle(windows: DataFrame, docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(window, k, h, at): each distinct window with its prefix shingle, the one that occurs least in the documents."""
    distinct = windows.select("window").distinct().withColumn("k", F.least(F.size("window"), F.lit(SHINGLE)))
    offsets = F.sequence(F.lit(0), F.size("window") - F.col("k"))
    shingles = distinct.select("window", "k", F.explode(offsets).alias("at")).select("window", "k", "at", *[
        F.when(F.col("k") > i, F.try_element_at("window", F.col("at") + i + 1)).alias(f"w{i}") for i in range(SHINGLE)])
    shingles = stored(shingles.select("window", "k", "at", F.xxhash64(*[f"w{i}" for i in range(SHINGLE)]).alias("h")), "shingles")
    wanted = stored(shingles.select("k", "h").distinct().withColumn("part", F.pmod("h", F.lit(1 << 20))), "wanted")
    counted = []
    for k, part in _blocks(wanted, block_rows):
        found = _positions(docs).filter(F.col("z").isNotNull()).select(_shingle_hash("z", k).alias("h"))
        counted.append(found.join(F.broadcast(part.select("h")), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k)))
    if not counted:
        return shingles.select("window", "k", "h", "at").limit(0)
    counts = reduce(DataFrame.unionByName, counted)
    ranked = shingles.join(counts, ["k", "h"], "left").select("window", "k", "h", "at", F.coalesce("n", F.lit(0)).alias("n"))
    # A shingle that no document has cannot lead to a match: its windows need no further look.
    return (ranked.groupBy("window", "k").agg(F.min(F.struct("n", "h", "at")).alias("m"))
            .filter("m.n > 0").select("window", "k", F.col("m.h").alias("h"), F.col("m.at").alias("at")))


def _blocks(rows: DataFrame, block_rows: int) -> list[tuple[int, DataFrame]]:
    """(shingle length, rows) pieces of at most about ``block_rows`` rows each, dealt by ``part``."""
    pieces = []
    for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect():  # three lengths at most
        n = -(-r["n"] // block_rows)
        pieces += [(r["k"], rows.filter((F.col("k") == r["k"]) & (F.pmod("part", F.lit(n)) == i))) for i in range(n)]
    return pieces


def matches(docs: DataFrame, index: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, doc_id, n_words, start, length, window_id): one row per document with start null, and one per occurring window."""
    index = index.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(1 << 20)))
    found = [_positions(docs).filter("pos is null or pos = 0").select(
        "row", "doc_id", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("window_id"))]
    blocks = _blocks(index, block_rows)
    for n, (k, part) in enumerate(blocks):
        side = F.broadcast(part.select(F.col("h").alias("ih"), "at", F.size("window").alias("length"), F.array_join("window", " ").alias("text"), "window_id"))
        placed = _positions(docs).select("row", "doc_id", "n_words", "w", "pos", F.when(F.col("z").isNotNull(), _shingle_hash("z", k)).alias("h"))
        joined = placed.join(side, F.col("h") == F.col("ih"), "left" if n == 0 else "inner")
        start = (F.col("pos") - F.col("at")).alias("start")
        fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("length") <= F.col("n_words"))
        same = F.array_join(F.slice("w", F.col("pos") - F.col("at") + 1, F.col("length")), " ") == F.col("text")
        hit = F.when(F.col("ih").isNotNull() & fits, same).otherwise(F.lit(False))
        if n == 0:  # the first pass also reports each document
            first = F.coalesce(F.col("pos"), F.lit(0)) == 0
            rows = joined.withColumn("hit", hit).filter(F.col("hit") | first)
            found = [rows.select("row", "doc_id", "n_words", *[F.when(F.col("hit"), c).alias(a) for c, a in (
                (start, "start"), (F.col("length"), "length"), (F.col("window_id"), "window_id"))])]
        else:
            found.append(joined.filter(hit).select("row", "doc_id", "n_words", start, "length", "window_id"))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see the module's text for odd rows."""
    windows = stored(windows_of(benchmark, window).withColumn("window_id", F.xxhash64(F.array_join("window", " "), F.size("window"))), "windows")
    index = stored(rarest_shingle(windows, docs, block_rows).withColumn(
        "window_id", F.xxhash64(F.array_join("window", " "), F.size("window"))), "prefixes")
    found = stored(matches(docs, index, block_rows), "matches")
    hits = found.filter(F.col("start").isNotNull())
    # The words hit: the part of each window behind all windows that start before it.
    order = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    fresh = spans.withColumn("before", F.coalesce(F.max("end").over(order), F.lit(0)))
    n_hit = fresh.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))).cast("long").alias("n_hit"))
    items = (hits.select("row", "window_id").distinct().join(windows.select("window_id", "item_id"), "window_id")
             .groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    documents = found.groupBy("row", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return documents.join(n_hit, "row", "left").join(items, "row", "left").select(
        "doc_id", "n_words", n.alias("n_hit"), F.greatest(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n > 0) & (SHARE * n >= F.col("n_words"))).alias("contaminated"), "row")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows, with all their columns, that are not contaminated. Each is judged by its text, whatever its id."""
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = decontaminate(docs.select(digest.alias("doc_id"), "text"), benchmark, window, block_rows).filter("contaminated")
    mark, hit = free_names(docs, "_digest", "_gone")
    gone = stored(found.select(F.col("doc_id").alias(hit)).distinct(), "contaminated")
    return docs.withColumn(mark, digest).join(gone, F.col(mark) == F.col(hit), "left_anti").drop(mark)
