"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

1 quality: documents the byte network scores below the threshold go.
2 toxicity: documents the sentence model calls toxic go.
3 near-duplicates: of each SimHash group one document stays, the one with the smallest id.
4 decontamination: documents that hold benchmark passages go.
5 packing: the rest is cut into pieces and packed; this stage returns pieces, the others documents.

Odd rows: null and empty texts are judged like any text. Rows that share an id are judged each by its own text.
Of rows without an id, stage 3 keeps one of each group that has no row with an id. Empty tables pass through all
stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import decontaminate, packing, quality_cnn, simhash, toxicity_mil
from plumbline.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.keep_good(docs, quality_cnn.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_mil.keep_clean(docs, toxicity_mil.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality), ("toxicity", toxicity), ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination), ("best-fit packing", packed),
]

#: Learned models and a tokenizer's vocabulary are no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
