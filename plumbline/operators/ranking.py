"""Ranks and running sums that stay balanced when one key holds most rows.

A plain window puts a whole partition key into one task. Here every key is first cut into ordered
slices; slice totals give each slice its offset, and only a slice is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.hashing import uniform

SLICES = 1 << 14


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps rows whose key is NULL; right keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_shuffled(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of two sides that both grow with the data.

    Spark guesses the size of a side from its files, and knows nothing of rows that are exploded or of strings that
    are put together; a side that looks small is sent whole through the driver. Here both sides are dealt by key.
    """
    return left.join(right.hint("merge"), on, how)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """First n rows per key. The rank filter becomes a per-task limit before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def _add_offsets(sliced: DataFrame, offsets: DataFrame) -> DataFrame:
    """The rows plus one opening row per slice that brings the amount of all slices before it.

    The opening row sorts first, so the window over a slice starts from the right value. That
    needs no join, and the rows are shuffled once, for the window.
    """
    rows = sliced.withColumn("_is_row", F.lit(True)).withColumn("_key_total", F.lit(None).cast("bigint"))
    opening = offsets.withColumn("_is_row", F.lit(False))
    return rows.unionByName(opening, allowMissingColumns=True)


def hash_rank(
    df: DataFrame, strata: Sequence[str], seed: int, key: str, rank: str = "draw_rank",
    total: str = "stratum_size", slices: int = SLICES,
) -> DataFrame:
    """Seeded random order inside each stratum: exact 1-based rank and stratum size.

    The draw depends on seed, stratum and key only, so other strata never shift it. Slices are
    ranges of the uniform draw, hence of about equal size.
    """
    strata = list(strata)
    drawn = df.withColumn("_u", uniform(F.lit(seed), *[F.col(s) for s in strata], F.col(key)))
    sliced = drawn.withColumn("_slice", F.floor(F.col("_u") * slices)).withColumn("_step", F.lit(1).cast("bigint"))
    per_slice = sliced.groupBy(*strata, "_slice").agg(F.sum("_step").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = per_slice.select(
        *strata, "_slice", (upto - F.col("_n")).alias("_step"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias("_key_total"))
    inside = Window.partitionBy(*strata, "_slice")
    ordered = inside.orderBy("_is_row", "_u", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _add_offsets(sliced, offsets).withColumn(rank, F.sum("_step").over(ordered)).withColumn(
        total, F.first("_key_total").over(ordered))
    return ranked.filter("_is_row").drop("_u", "_slice", "_step", "_is_row", "_key_total")


def running_total(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], amount: Column, out: str,
    units: Sequence[str] = ("hour", "second"),
) -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the key and this one, in time order.

    ``units`` go from coarse to fine. Rows are ordered within a slice of the finest unit only; the
    slice totals are themselves summed up the same way, one unit coarser. Traffic so dense that a
    second is too much for one task takes ("hour", "second", "microsecond").
    """
    keys, unit = list(keys), units[-1]
    sliced = df.withColumn("_step", amount.cast("bigint")).withColumn("_slice", F.date_trunc(unit, F.col(ts)))
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("_step").alias("_n"))
    if len(units) > 1:
        upto = running_total(per_slice.withColumnRenamed("_slice", "_at"), keys, "_at", [], F.col("_n"), "_upto", units[:-1])
        upto = upto.withColumnRenamed("_at", "_slice")
    else:
        ordered = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = per_slice.withColumn("_upto", F.sum("_n").over(ordered))
    offsets = upto.select(*keys, "_slice", (F.col("_upto") - F.col("_n")).alias("_step"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_is_row", ts, *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = _add_offsets(sliced, offsets).withColumn(out, F.sum("_step").over(inside))
    return summed.filter("_is_row").drop("_step", "_slice", "_is_row", "_key_total")
