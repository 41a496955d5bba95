"""Exact cost arithmetic: integers of nano-USD everywhere, decimals only at the edge."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

USAGE_FIELDS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
OPTIONAL_PRICES = ("cache_read", "cache_write")


def nano_per_token(usd_per_mtok: Column) -> Column:
    """Price per token: one dollar per million tokens is 1000 nano-USD a token."""
    return F.bround(usd_per_mtok * 1000).cast("bigint")


def nano_to_usd(nano: Column) -> Column:
    return F.bround(nano / F.lit(10.0)) / F.lit(1e8)


def usage_cost_error(prefix: str = "") -> Column:
    """Why a row cannot be priced honestly; NULL when it can."""
    checks = [
        F.when(F.col(field) < 0, F.lit(f"negative {field}")) for field in USAGE_FIELDS
    ]
    checks += [
        F.when(F.col(f"{prefix}input_nano").isNull(), F.lit("unknown model")),
    ]
    checks += [
        F.when(
            (F.col(f"{name}_tokens") > 0) & F.col(f"{prefix}{name}_nano").isNull(),
            F.lit(f"unverified {name} price"),
        )
        for name in OPTIONAL_PRICES
    ]
    return F.coalesce(*checks)


def usage_cost(prefix: str = "") -> Column:
    total = F.lit(0).cast("bigint")
    for field in USAGE_FIELDS:
        price = F.col(f"{prefix}{field.removesuffix('_tokens')}_nano")
        tokens = F.coalesce(F.col(field), F.lit(0))
        total = total + F.when(tokens == 0, F.lit(0)).otherwise(tokens * price).cast("bigint")
    return total
