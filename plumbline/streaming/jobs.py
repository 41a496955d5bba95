"""Structured Streaming sinks, and the spend, routing and cache jobs that need no state of their own.

Jobs that remember open requests, a day's spend or a provider's failures are in ``stateful``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import routing

# ---- fixed values -------------------------------------------------------------------------
DELIVERY_WINDOW = "24 hours"
FLUSH_INTERVAL = "1 second"
# -------------------------------------------------------------------------------------------


def append_sink(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                partition_by: str | None = None, interval: str = FLUSH_INTERVAL) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once per row."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(path)


def stream_traces_sink(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    dated = stream.withColumn("date", F.to_date("created_at"))
    return append_sink(dated, path, checkpoint, available_now, "date")


def dedupe_deliveries(deliveries: DataFrame, ts: str = "at", key: str = "delivery_id", window: str = DELIVERY_WINDOW) -> DataFrame:
    return deliveries.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def stream_spend(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    hours = stream.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 hour").alias("_w"), "model_served")
    return hours.agg(F.count(F.lit(1)).alias("requests"), F.sum("cost_nano").alias("cost_nano"), F.count_if(F.col("cost_nano").isNull()).alias("unpriced")).select(
        F.col("_w.start").alias("hour"), "model_served", "requests", "cost_nano", "unpriced")


def stream_route(requests: DataFrame, policy: DataFrame, default_mode: str, fallback: str, safe_default: str) -> DataFrame:
    return routing.route_traffic(requests, policy, default_mode, fallback, safe_default)


# ---- semantic cache table -----------------------------------------------------------------

CACHE_KEY = ("request_hash", "model", "prompt_version")


def resolve_cache(log: DataFrame) -> DataFrame:
    """Current entries from the append-only log of stores: first identity, latest response and expiry."""
    born = F.min_by(F.struct("entry_id", "vec"), F.struct("stored_at", "entry_id"))
    last = F.max_by(F.struct("response", "expires_at"), F.struct("stored_at", "entry_id"))
    return log.groupBy(*CACHE_KEY).agg(born.alias("_b"), last.alias("_l"), F.count(F.lit(1)).alias("stores")).select(
        *CACHE_KEY, "_b.*", "_l.*", "stores")


def expire_entries(entries: DataFrame, now: Column) -> DataFrame:
    return entries.filter(F.col("expires_at") > now)


def invalidate_version(entries: DataFrame, prompt_version: str) -> DataFrame:
    return entries.filter(F.col("prompt_version") != prompt_version)


def record_hits(entries: DataFrame, hit_log: DataFrame) -> DataFrame:
    hits = hit_log.groupBy("entry_id").agg(F.count(F.lit(1)).alias("hits"), F.max("hit_at").alias("last_hit_at"))
    return entries.join(hits, "entry_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
