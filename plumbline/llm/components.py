"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import stored

MAX_ROUNDS = 64


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Connects the neighbours of each node (all larger ones, or all smaller ones and itself) to its smallest neighbour."""
    if larger_only:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if larger_only:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): each node with a smaller one in its component, and the smallest of the component.

    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    The rounds grow with the logarithm of the longest chain; more than ``MAX_ROUNDS`` raise.
    """
    now, seen = edges.filter(F.col("a") != F.col("b")).select("a", "b"), None
    for _ in range(MAX_ROUNDS):
        now = stored(_stars(_stars(now, True), False), "stars")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            return now
        seen = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def smallest_reachable(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, component): for every class the smallest ``first_id`` among all classes that links reach."""
    roots = stars(edges).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    placed = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component"))
    return placed.join(least, "root").select("fp", "component")
