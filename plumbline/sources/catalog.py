"""The price and capability dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.money import nano_per_token

PRICES = ("input", "output", "cache_read", "cache_write")


def price_catalog(table: DataFrame) -> DataFrame:
    """Catalogue rows with integer prices. ``table`` holds dollars per million tokens.

    A NULL cache price stays NULL: it means unverified, never free. Input and output prices are
    required.
    """
    missing = F.col("input").isNull() | F.col("output").isNull()
    problem = F.concat(F.lit("no verified price for "), F.col("model"))
    other = [c for c in table.columns if c not in PRICES]
    priced = table.withColumn("input", F.when(missing, F.raise_error(problem).cast("double")).otherwise(F.col("input")))
    return priced.select(*other, *[nano_per_token(F.col(p)).alias(f"{p}_nano") for p in PRICES])
