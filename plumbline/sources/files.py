"""Strict JSON-lines sources, content-addressed stores, trace tables and report sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.session import stored

MESSAGES = "array<struct<content:string,role:string>>"
CORPUS_SCHEMA = (
    f"ground_truth string, messages {MESSAGES}, slug string, source_dataset string, source_id string, "
    "source_license string, split string, task_type string, verifiable boolean, verifier string")
LABEL_SCHEMA = (
    "candidate_model string, elapsed_ms bigint, labeled_at string, labeler string, pair_id string, "
    "slug string, task_type string, outcome string")
PAIR_SCHEMA = (
    "human_verified boolean, label string, left_slug string, left_text string, pair_id string, "
    "right_slug string, right_text string, similarity double, source string")
RECORD_SCHEMA = (
    "agreement map<string,double>, cost_nano map<string,bigint>, slug string, split string, "
    "success map<string,boolean>, task_type string, verifier_confidence map<string,double>")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known shape. A malformed line stops the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_sorted_json(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order; NULLs are written, so a row always has every key."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_strict(spark, path, CORPUS_SCHEMA)


def last_label_wins(labels: DataFrame) -> DataFrame:
    """One row per pair: the latest label, by content where times are equal."""
    order = F.struct("labeled_at", *[c for c in sorted(labels.columns) if c not in ("labeled_at", "pair_id")])
    rest = F.struct(*[c for c in labels.columns if c != "pair_id"])
    return labels.groupBy("pair_id").agg(F.max_by(rest, order).alias("_l")).select("pair_id", "_l.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return last_label_wins(read_strict(spark, path, LABEL_SCHEMA))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs; a path that does not exist is an empty set."""
    try:
        return read_strict(spark, path, PAIR_SCHEMA)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], PAIR_SCHEMA)
        raise


def records_to_maps(long: DataFrame) -> DataFrame:
    """Long evidence to one row per item with maps keyed by model, for the JSON form.

    The maps have one entry per model of the ladder.
    """
    def by_model(value: str) -> Column:
        pairs = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("model", value)))
        return F.map_from_entries(F.array_sort(pairs)).alias(value)

    return long.groupBy("slug", "task_type", "split").agg(
        *[by_model(v) for v in ("success", "cost_nano", "agreement", "verifier_confidence")])


def records_to_long(wide: DataFrame) -> DataFrame:
    return wide.select(
        "slug", "task_type", "split", F.explode("success").alias("model", "success"),
        "cost_nano", "agreement", "verifier_confidence",
    ).select(
        "slug", "task_type", "split", "model", "success",
        *[F.try_element_at(c, F.col("model")).alias(c) for c in ("cost_nano", "agreement", "verifier_confidence")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return records_to_long(read_strict(spark, path, RECORD_SCHEMA))


def write_records(long: DataFrame, path: str) -> None:
    write_sorted_json(records_to_maps(long), path)


# ---- content-addressed stores -------------------------------------------------------------

def _packed(key: Column) -> Column:
    """The same key in fewer bytes, to be sent: pairs of hex digits are one byte, any other text stays. Exact."""
    return F.when(F.lower(F.hex(F.unhex(key))) == key, F.concat(F.unhex(F.lit("01")), F.unhex(key))).otherwise(F.concat(F.unhex(F.lit("00")), key.cast("binary")))


def _unpacked(packed: Column) -> Column:
    rest = F.substring(packed, 2, (1 << 31) - 1)
    return F.when(F.substring(packed, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _digest(key: Column) -> Column:
    """128 bits of SHA-256, by which the store tells keys apart that it holds or lacks; a key that is null has one that no other key has."""
    return F.coalesce(F.unhex(F.substring(F.sha2(key, 256), 1, 32)), F.unhex(F.lit("00")))


class KeyedStore:
    """Write-once Parquet table addressed by a content key, partitioned by the key's prefix.

    Writes append only keys that are not there yet, each once; a null key equals none. Rows cross the network once, and only
    if they are new: a write into a store that holds something first compares digests, and then reads its rows again. Reading and writing stop at a file that cannot be
    read, as its keys would be lost or written twice; only a lookup (``get``, ``missing``) takes them for misses.
    ``repair`` sets such files aside and writes their keys anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "cache_key", prefix_chars: int = 1) -> None:
        self.spark, self.path, self.key, self.prefix_chars = spark, path, key, prefix_chars
        self.schema = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("prefix", T.StringType())])

    def table(self, readable_only: bool = False) -> DataFrame:
        try:
            return (self.spark.read.schema(self.schema).option("ignoreCorruptFiles", str(readable_only).lower())
                    .parquet(self.path).drop("prefix"))
        except AnalysisException as err:
            if err.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], self.schema).drop("prefix")
            raise

    def get(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.table(readable_only=True), self.key)

    def _held(self, readable_only: bool = False) -> DataFrame:
        return self.table(readable_only).filter(F.col(self.key).isNotNull()).select(_digest(F.col(self.key)).alias("_digest"))

    def missing(self, wanted: DataFrame, once: bool = False) -> DataFrame:
        """The rows whose keys the store lacks; ``once``: of equal rows one."""
        lost = wanted.withColumn("_digest", _digest(F.col(self.key))).join(self._held(readable_only=True), "_digest", "left_anti")
        if once:
            lost = lost.groupBy("_digest", *[c for c in wanted.columns if c != self.key]).agg(F.first(self.key).alias(self.key))
        return lost.select(wanted.columns)

    def put(self, rows: DataFrame) -> None:
        if not self.table().isEmpty():
            rows = rows.withColumn("_digest", _digest(F.col(self.key)))
            fresh = stored(rows.select("_digest").distinct().join(self._held(), "_digest", "left_anti"), "fresh")
            if fresh.isEmpty():
                return
            rows = rows.join(fresh, "_digest", "left_semi").drop("_digest")
        self.append(rows)

    def append(self, rows: DataFrame) -> None:
        """Writes rows, one of each key, whose keys the store lacks."""
        content = [c for c in rows.columns if c != self.key]
        once = rows.groupBy(_packed(F.col(self.key)).alias("_key")).agg(F.min(F.struct(*content)).alias("_r")).select(_unpacked(F.col("_key")).alias(self.key), "_r.*")
        # A task has rows of all prefixes and writes a file for each; AQE gives small writes few tasks.
        once.withColumn("prefix", F.substring(self.key, 1, self.prefix_chars)).write.mode("append").option(
            "compression", "zstd").partitionBy("prefix").parquet(self.path)

    def unreadable(self) -> list[str]:
        """The files that cannot be read to their end; one read of each file."""
        bad = []
        for file in sorted(self.table().inputFiles()):
            try:
                rows = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "false").parquet(file)
                rows.write.format("noop").mode("overwrite").save()
            except (PySparkException, Py4JJavaError) as err:
                if "FAILED_READ_FILE" not in str(err) and "CANNOT_READ_FILE_FOOTER" not in str(err):
                    raise
                bad.append(file)
        return bad

    def repair(self, rows: DataFrame) -> list[str]:
        """Sets unreadable files aside under a hidden name, and puts those of ``rows`` whose keys no other file has.

        The files are kept, for a reader that can still use them, and their former names are returned. ``rows`` must not
        read this store."""
        bad = self.unreadable()
        jvm = self.spark._jvm
        for file in bad:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
            aside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_unreadable-{path.getName()}")
            if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).rename(path, aside):
                raise OSError(f"cannot set {file} aside")
        self.put(rows)
        return bad


Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed_all(texts: DataFrame, embedder: Embedder, dimensions: int, store: KeyedStore | None = None,
              batch: int = 64) -> DataFrame:
    """Embedding of every (key, text_hash, text) row; only texts the store lacks are embedded.

    Copies of a text are embedded once. Batches stream through the tasks; a vector of the wrong
    length stops the job.
    """
    todo = texts.groupBy("text_hash").agg(F.min("text").alias("text"))
    if store is not None:
        todo = todo.join(store.table().select(F.col(store.key).alias("text_hash")), "text_hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                vectors = [list(map(float, v)) for v in embedder(part["text"].tolist())]
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError(f"the embedder must return one vector of {dimensions} numbers per text")
                yield pd.DataFrame({"text_hash": part["text_hash"].values, "vec": vectors})

    fresh = todo.mapInPandas(run, "text_hash string, vec array<float>")
    if store is None:
        known = fresh
    else:
        store.append(fresh.withColumnRenamed("text_hash", store.key))  # one row a text, none of them held
        known = store.table().select(F.col(store.key).alias("text_hash"), "vec")
    return texts.select("key", "text_hash").join(known, "text_hash").select("key", "vec")


# ---- traces and reports -------------------------------------------------------------------

def append_traces(traces: DataFrame, path: str) -> None:
    """Append to the trace table, one folder per day."""
    dated = traces.withColumn("date", F.to_date("created_at"))
    dated.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def report_json(row: DataFrame, kind: str, version: int = 1, provenance: dict[str, object] | None = None) -> DataFrame:
    """One JSON document per row, keys in order, with kind, version and provenance."""
    extra = {"kind": kind, "artifact_version": version, **(provenance or {})}
    full = row
    for name, value in extra.items():
        full = full.withColumn(name, F.lit(value))
    return full.select(F.to_json(F.struct(*[F.col(c) for c in sorted(full.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_report(row: DataFrame, kind: str, path: str, version: int = 1, provenance: dict[str, object] | None = None) -> None:
    """Reports are small by nature, hence one file."""
    report_json(row, kind, version, provenance).coalesce(1).write.mode("overwrite").text(path)
