"""Scalar rules of the serving side: finish reasons, failure classes, expiry, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---- fixed values -------------------------------------------------------------------------
FINISH_REASONS = {"max_tokens": "length", "refusal": "content_filter", "tool_use": "tool_calls"}
# kind, retryable, counts toward the breaker, HTTP status, recorded error kind
FAILURE_KINDS = (
    ("timeout", True, True, 504, "timeout"),
    ("connection", True, True, 502, "connection"),
    ("rate_limited", True, False, 429, "rate_limited"),
    ("auth", False, True, 502, "provider_auth"),
    ("provider_5xx", True, True, 502, "provider_5xx"),
    ("bad_request", False, False, 400, "upstream_bad_request"),
    ("unknown", False, True, 502, "unknown"),
)
# -------------------------------------------------------------------------------------------

FAILURE_SCHEMA = "kind string, retryable boolean, counts_toward_breaker boolean, http_status int, error_kind string"


def map_finish_reason(reason: Column) -> Column:
    mapped = F.when(F.lit(False), F.lit(""))
    for source, target in FINISH_REASONS.items():
        mapped = mapped.when(reason == source, F.lit(target))
    return mapped.otherwise(F.lit("stop"))


def failure_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAILURE_KINDS), FAILURE_SCHEMA)


def classify_failure(kind: Column) -> Column:
    """STRUCT(retryable, counts_toward_breaker, http_status, error_kind); unlisted kinds are "unknown"."""
    def pack(row: tuple) -> Column:
        _, retryable, counts, status, error = row
        return F.struct(
            F.lit(retryable).alias("retryable"), F.lit(counts).alias("counts_toward_breaker"),
            F.lit(status).alias("http_status"), F.lit(error).alias("error_kind"),
        )

    chosen = F.when(F.lit(False), pack(FAILURE_KINDS[-1]))
    for row in FAILURE_KINDS[:-1]:
        chosen = chosen.when(kind == row[0], pack(row))
    return F.when(kind.isNotNull(), chosen.otherwise(pack(FAILURE_KINDS[-1])))


def ttl_seconds(route: Column, default_seconds: int, by_route: dict[str, int]) -> Column:
    """Per-route lifetime, zero included; the default elsewhere."""
    if not by_route:
        return F.lit(default_seconds)
    chosen = None
    for name, seconds in by_route.items():
        chosen = (F if chosen is None else chosen).when(route == name, F.lit(seconds))
    return chosen.otherwise(F.lit(default_seconds))


def ttl_expiry(now: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, now)


def stream_rate(output_tokens: Column, latency_ms: Column, ttft_ms: Column) -> Column:
    """Output tokens per second after the first one; NULL when nothing was streamed."""
    streamed = F.nullif(latency_ms - ttft_ms, F.lit(0))
    return output_tokens * F.lit(1000.0) / streamed


def millis_per_char(chars: Column, latency_ms: Column, ttft_ms: Column) -> Column:
    return (latency_ms - ttft_ms) / F.nullif(chars, F.lit(0))


def status_tone(status: Column) -> Column:
    return F.when(status >= 500, F.lit("5xx")).when(status >= 400, F.lit("4xx")).otherwise(F.lit("ok"))
