"""Helpers shared by the training-data operators: tables, byte tables, label samples, scratch tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Lower-cases A-Z and turns every ASCII byte that is neither a letter nor a digit into a space.
ALNUM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: The same, but the ends of sentences become line feeds.
SENTENCE_BYTES = bytes(0x0A if chr(b) in ".!?\n" else ALNUM_BYTES[b] for b in range(256))


BATCH_ROWS = 2000

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Python tasks import this package by name; where it is not installed, they look where the driver found it."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    # Texts may be long, so a batch for a task's Python has few rows.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """The rows written once to the folder all executors share, and read from there."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("overwrite").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame | None) -> None:
    """Removes what ``stored`` has written, once nothing reads it any more."""
    if table is not None:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Gives the memory this worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same batches; at the end of a task its worker, which others use after it, gives back the memory it has freed."""
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return of_task


def tidied(run: Callable) -> Callable:
    """The same for a function of one group or of two groups."""
    if len(inspect.signature(run).parameters) == 2:
        def of_two(left, right):
            out = run(left, right)
            give_back()
            return out

        return of_two

    def of_one(rows):
        out = run(rows)
        give_back()
        return out

    return of_one


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of the table is called that."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a row without an id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes; no text is the empty text."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch whose texts together stay near ``max_bytes``; one longer text is a cut of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, per_class: int,
                    longest: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of each class, in an order fixed by the hash of the id.

    Rows whose id falls into the held-out remainder are never taken, nor texts of more than ``longest``
    bytes, so that what reaches the driver is bounded by 2 * per_class * longest bytes. An id with several
    labels counts with the largest; an id that several rows share gives each of their texts.
    """
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
             .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
             .filter(remainder(F.col("_id"), modulus) != left_out)
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    order = [F.xxhash64("_id", F.lit(label)), F.col("_id")]
    taken = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy(*order).limit(per_class)
        taken = part if taken is None else taken.unionByName(part)
    # At most 2 * per_class rows of two numbers: small enough to broadcast whatever the tables hold.
    rows = (docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
            .filter(F.octet_length(F.coalesce("_t", F.lit(""))) <= longest)
            .join(F.broadcast(taken), F.col("_d") == F.col("_id"))
            .select("_id", F.coalesce("_t", F.lit("")).alias("_t"), "_y")
            .orderBy(*order, "_t").limit(2 * per_class).collect())
    return [(r["_t"], r["_y"]) for r in rows]
