"""Hash-derived randomness: the same rows get the same draw under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(value: Column | str | int | float) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def uniform(*parts: Column | int | float) -> Column:
    """Uniform in [0, 1) from the md5 of the ``|``-joined parts."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def slot_for(seed: int, *parts: Column) -> Column:
    """Which slot (A or B) the candidate occupies, fixed by the seed."""
    return F.when(uniform(F.lit(seed), *parts) < 0.5, F.lit("A")).otherwise(F.lit("B"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
