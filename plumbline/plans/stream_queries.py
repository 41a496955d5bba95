"""Streaming jobs over the event table as a file stream, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.registry import registered
from plumbline.plans.routing_queries import _ROUTED, _ROUTES, routes_from_events
from plumbline.plans.trace_queries import _HOURLY, _INCIDENTS, _RUNS, _SOME_UNPRICED, some_unpriced
from plumbline.session import shared_dir
from plumbline.streaming import jobs, stateful

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table's files as a stream: the pattern matches one file as well as a folder of part files."""
    return spark.readStream.schema(EVENTS).parquet(f"{d}/event[s].parquet")


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Everything the stream appends until its input ends."""
    spark = stream.sparkSession
    out = shared_dir(spark, name)
    jobs.append_sink(stream, out, shared_dir(spark, f"{name}-progress"), available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


Build = Callable[..., DataFrame]


def in_arrivals(spark: SparkSession, arriving: list[DataFrame], arrivals: int, build: Build, name: str) -> DataFrame:
    """What a query over files appends when they come in several arrivals, each followed by a run that takes up where the last one ended.

    ``_arrival`` of each table says when a row comes; ``build`` makes the query from the tables as streams.
    """
    folders = [shared_dir(spark, f"{name}-in") for _ in arriving]
    out, progress = shared_dir(spark, name), shared_dir(spark, f"{name}-progress")
    for i in range(arrivals):
        streams = []
        for table, folder in zip(arriving, folders):
            rows = table.filter(F.col("_arrival") == i).drop("_arrival")
            rows.write.mode("append").parquet(folder)
            streams.append(spark.readStream.schema(rows.schema).parquet(folder))
        stream = build(*streams)
        jobs.append_sink(stream, out, progress, available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def again(appended: DataFrame) -> DataFrame:
    """A table that a stream has appended to, as the stream of its files."""
    spark = appended.sparkSession
    folder = appended.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(appended.schema).parquet(folder)


#: Thirds of the month, and a sixth of all rows that come with the next third: later than any row of theirs, but within the lateness.
ARRIVALS, LATENESS = 3, "11 days"


def disordered(rows: DataFrame, ts: str, delayed: Column) -> DataFrame:
    third = F.floor((F.dayofmonth(ts) - 1) / 10)
    return rows.withColumn("_arrival", F.least(F.when(delayed, third + 1).otherwise(third), F.lit(ARRIVALS - 1)))


@registered("stream_traces_sink", o.query("SELECT created_at::DATE AS date, count(*) AS rows, sum(cost_nano)::BIGINT AS cost_nano FROM traces GROUP BY 1", "traces"))
def stream_traces_sink(spark, d):
    out = shared_dir(spark, "stream-traces")
    stream = fx.trace_columns(event_stream(spark, d))
    jobs.stream_traces_sink(stream, out, shared_dir(spark, "stream-traces-progress"), True).awaitTermination()
    return spark.read.parquet(out).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("cost_nano").alias("cost_nano"))




@registered("assemble_traces_stream", o.query(
    """SELECT request_id, model, input_tokens, output_tokens, text, thinking_chars, latency_ms, ttft_ms, usage_is_final, finish_reason, error_kind FROM assembled JOIN ended USING (request_id)
       WHERE usage_is_final OR epoch_ms(last)+120000 < (SELECT epoch_ms(max(seen_at)-INTERVAL 11 DAY) FROM event_log)""", "assembled",
    ended="SELECT request_id, max(seen_at) AS last FROM event_log GROUP BY 1"))
def assemble_traces_stream(spark, d):
    """The event log folded as it arrives, in three disordered arrivals; requests that broke off in the last days are still open."""
    events = fx.event_log_columns(fx.load(spark, d, "events"))
    log = disordered(events, "at", (F.col("request_id") + F.col("seq")) % 6 == 0)
    folded = in_arrivals(spark, [log], ARRIVALS, lambda s: stateful.assemble_traces_stream(s, lateness=LATENESS), "stream-assembled")
    return folded.select(
        "request_id", "model", "input_tokens", "output_tokens", "text", "thinking_chars", "latency_ms", "ttft_ms", "usage_is_final", "finish_reason", "error_kind")


@registered("dedupe_deliveries", o.query("SELECT DISTINCT user_id*1000+extract(hour FROM ts) AS delivery_id FROM events"))
def dedupe_deliveries(spark, d):
    """First delivery of each id; the ids repeat within the window the state is kept for."""
    stream = event_stream(spark, d).select((F.col("user_id") * 1000 + F.hour("ts")).alias("delivery_id"), F.col("ts").cast("timestamp").alias("at"))
    return finished(jobs.dedupe_deliveries(stream, window="60 days"), "stream-deliveries").select("delivery_id")


@registered("stream_spend", o.query("SELECT hour, model_served, requests, cost_nano, unpriced FROM hourly WHERE hour+INTERVAL 1 HOUR <= (SELECT max(created_at)-INTERVAL 1 HOUR FROM traces)", "traces", hourly=_HOURLY))
def stream_spend(spark, d):
    """Hours the watermark has closed."""
    return finished(jobs.stream_spend(fx.trace_columns(event_stream(spark, d))), "stream-spend")


_CLOSED = "SELECT * FROM {rows} WHERE date_trunc('minute',created_at)+INTERVAL 1 MINUTE <= (SELECT max(created_at)-INTERVAL 11 DAY FROM {rows} {where})"


@registered("stream_failure_runs", o.query(
    "SELECT provider, first_failure_at, opened_at, opened_at+INTERVAL 30 SECOND AS half_open_at FROM incidents", "traces",
    closed=_CLOSED.format(rows="traces", where="WHERE counts IS NOT NULL"), runs=_RUNS.replace("FROM traces", "FROM closed"), incidents=_INCIDENTS))
def stream_failure_runs(spark, d):
    """Incidents of the minutes the watermark has closed, from three disordered arrivals."""
    rows = disordered(fx.traces(spark, d).select("id", "provider", "created_at", "counts"), "created_at", F.col("id") % 6 == 0)
    slices = in_arrivals(spark, [rows], ARRIVALS, lambda s: stateful.health_slices(s, LATENESS), "stream-health")
    return finished(stateful.incidents(again(slices)), "stream-incidents")


@registered("stream_cap_alert", o.query(
    """SELECT day, 'cap' AS kind, id, spent_nano, minute, NULL::BIGINT AS unpriced FROM running WHERE spent_nano>80000000 AND spent_nano-coalesce(cost_nano,0)<=80000000
       UNION ALL SELECT day, 'unpriced', NULL, NULL, min(minute), arg_min(n, minute) FROM (SELECT day, minute, count(*) AS n FROM running WHERE cost_nano IS NULL GROUP BY 1, 2) GROUP BY 1""",
    "traces", partly=_SOME_UNPRICED, closed=_CLOSED.format(rows="partly", where=""),
    running="""SELECT *, created_at::DATE AS day, date_trunc('minute',created_at) AS minute,
       sum(coalesce(cost_nano,0)) OVER (PARTITION BY created_at::DATE ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent_nano FROM closed"""))
def stream_cap_alert(spark, d):
    """Days over the cap and days with rows that have no price, from three disordered arrivals."""
    cap = 80_000_000
    rows = some_unpriced(fx.traces(spark, d).select("id", "created_at", "cost_nano"))
    arriving = disordered(rows, "created_at", F.col("id") % 6 == 0)
    slices = in_arrivals(spark, [arriving], ARRIVALS, lambda s: stateful.spend_slices(s, LATENESS), "stream-spend-slices")
    alerts = finished(stateful.cap_alerts(again(slices), cap), "stream-alerts")
    crossed = stateful.crossing_rows(alerts, rows, cap).select(
        "day", F.lit("cap").alias("kind"), "id", "spent_nano", F.date_trunc("minute", "created_at").alias("minute"), F.lit(None).cast("bigint").alias("unpriced"))
    none = F.lit(None).cast("bigint")
    return crossed.unionByName(alerts.filter("kind = 'unpriced'").select("day", "kind", none.alias("id"), none.alias("spent_nano"), "minute", "unpriced"))


@registered("stream_route", o.query("SELECT * FROM routed", "requests", routes=_ROUTES, routed=_ROUTED))
def stream_route(spark, d):
    stream = fx.request_columns(event_stream(spark, d))
    routed = jobs.stream_route(stream, routes_from_events(spark, d), "offline", fx.STRONG, fx.STRONG)
    return finished(routed.select("request_id", "reason", "model_served", "route_key"), "stream-route")


#: Usage is reported 10 to 130 seconds after the finish, for one request in nine never; a fifth of it arrives a week later.
_WEEKS, _REPORTED = 4, "floor((extract(day FROM ts)-1)/8)::BIGINT"
_USAGE = f"""SELECT event_id AS request_id, ts + to_seconds(10+event_id%7*20) AS reported_at, floor(value)::BIGINT AS output_tokens,
  least(floor((extract(day FROM ts + to_seconds(10+event_id%7*20))-1)/8)::BIGINT + CASE WHEN event_id%5=0 THEN 1 ELSE 0 END, 3) AS arrival FROM events WHERE event_id%9<>0"""
_REACHED = "SELECT arrival, max(max(reported_at)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM usage GROUP BY arrival"


def _weekly(ts: str, delayed: Column) -> Column:
    week = F.floor((F.dayofmonth(ts) - 1) / 8)
    return F.least(F.when(delayed, week + 1).otherwise(week), F.lit(_WEEKS - 1))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = fx.load(spark, d, "events").filter(i % 9 != 0).select(
        i.alias("request_id"), F.timestamp_add("SECOND", (10 + i % 7 * 20).cast("int"), F.col("ts").cast("timestamp")).alias("reported_at"),
        F.floor("value").cast("bigint").alias("output_tokens"))
    return rows.withColumn("_arrival", _weekly("reported_at", F.col("request_id") % 5 == 0))


@registered("stream_late_rows", o.query(
    "SELECT arrival, count(*) AS rows, count(*) FILTER (reported_at <= newest - INTERVAL 1 HOUR) AS late FROM usage JOIN reached USING (arrival) GROUP BY 1",
    usage=_USAGE, reached=_REACHED))
def stream_late_rows(spark, d):
    """Usage reports per arrival, and how many of them came behind the watermark of the arrivals before."""
    usage = _usage(spark, d)
    on_time = in_arrivals(spark, [usage], _WEEKS, lambda s: stateful.accepted_on_time(s, "1 hour", "reported_at", "request_id", "at"), "stream-on-time")
    late = stateful.left_behind(usage, on_time, "request_id").groupBy("_arrival").agg(F.count(F.lit(1)).alias("late"))
    rows = usage.groupBy("_arrival").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(late, "_arrival", "left").select(F.col("_arrival").alias("arrival"), "rows", F.coalesce("late", F.lit(0)).alias("late"))


@registered("settle_usage", o.query(
    """SELECT f.request_id, coalesce(u.output_tokens, f.floor_tokens) AS output_tokens, u.request_id IS NOT NULL AS usage_is_final
       FROM done f LEFT JOIN accepted u ON u.request_id=f.request_id AND u.reported_at <= f.finished_at + INTERVAL 90 SECOND
       WHERE u.request_id IS NOT NULL OR f.finished_at + INTERVAL 90 SECOND < (SELECT least(max(d.finished_at), (SELECT max(reported_at) FROM usage)) - INTERVAL 1 HOUR FROM done d)""",
    usage=_USAGE, done=f"SELECT event_id AS request_id, ts AS finished_at, floor(value/2)::BIGINT AS floor_tokens, {_REPORTED} AS arrival FROM events",
    reached="""SELECT arrival, least(max(max(reported_at)) OVER w, (SELECT max(finished_at) FROM done d WHERE d.arrival < u.arrival)) AS newest
       FROM usage u GROUP BY arrival WINDOW w AS (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    accepted="SELECT * FROM usage JOIN reached USING (arrival) WHERE newest IS NULL OR reported_at > newest - INTERVAL 1 HOUR"))
def settle_usage(spark, d):
    """Finished requests with the usage that came in time; the others keep a floor and are not confirmed."""
    done = fx.load(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("finished_at"), F.floor(F.col("value") / 2).cast("bigint").alias("floor_tokens"))
    done = done.withColumn("_arrival", _weekly("finished_at", F.lit(False)))
    settled = in_arrivals(spark, [done, _usage(spark, d)], _WEEKS, lambda f, u: stateful.settle_usage(f, u, "1 hour", "90 seconds"), "stream-settled")
    return settled.select("request_id", "output_tokens", "usage_is_final")


_LOG = "event_type AS request_hash, {m} AS model, CASE WHEN user_id%2=0 THEN 'v1' ELSE 'v2' END AS prompt_version, event_id AS entry_id, ts AS stored_at, 'r'||event_id AS response, ts+to_seconds(floor(value)::BIGINT*3600) AS expires_at".format(m=o.model("event_id"))


@registered("cache_table", o.query(
    """SELECT e.request_hash, e.model, e.prompt_version, e.entry_id, e.response, e.expires_at, e.stores, coalesce(h.hits,0) AS hits FROM (
       SELECT request_hash, model, prompt_version, min_by(entry_id,stored_at) AS entry_id, max_by(response,stored_at) AS response, max_by(expires_at,stored_at) AS expires_at, count(*) AS stores FROM log GROUP BY 1,2,3) e
       LEFT JOIN (SELECT user_id AS entry_id, count(*) AS hits FROM events GROUP BY 1) h USING (entry_id) WHERE expires_at>TIMESTAMP '2024-01-30 12:00:00' AND prompt_version<>'v2'""", log=f"SELECT {_LOG} FROM events"))
def cache_table(spark, d):
    """Cache stores as a stream into an append-only log; then upsert, expiry, invalidation and hits are read off it."""
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    stores = event_stream(spark, d).select(
        F.col("event_type").alias("request_hash"), fx.model_of(eid).alias("model"), F.when(F.col("user_id") % 2 == 0, "v1").otherwise("v2").alias("prompt_version"),
        eid.alias("entry_id"), F.array(F.col("value").cast("float")).alias("vec"), ts.alias("stored_at"), F.concat(F.lit("r"), eid).alias("response"),
        F.timestamp_add("HOUR", F.floor("value").cast("int"), ts).alias("expires_at"))
    entries = jobs.resolve_cache(finished(stores, "stream-cache"))
    live = jobs.invalidate_version(jobs.expire_entries(entries, F.lit("2024-01-30 12:00:00").cast("timestamp")), "v2")
    hits = fx.load(spark, d, "events").select(F.col("user_id").alias("entry_id"), F.col("ts").alias("hit_at"))
    return jobs.record_hits(live, hits).drop("vec", "last_hit_at")
