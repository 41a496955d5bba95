import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True)
def package_for_tasks(spark):
    from plumbline.llm.common import importable

    importable(spark)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names the operators use inside."""
    def build(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame([tuple(r) for r in rows], schema).repartition(3)
        from pyspark.sql import functions as F

        return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("row"), F.lit(2).alias("fp"), F.lit("x").alias("key"), F.lit(3).alias("slice"),
                         *[F.lit(7).alias(c) for c in ("_digest", "__digest", "_gone", "_kept_id", "_KEPT_DIGEST")])

    return build
