"""Streams that remember: open requests, spend against a cap, providers in trouble, usage that comes late.

What can be counted per time slice is a windowed aggregation under a watermark, which spreads over all tasks and tolerates
any order of arrival within the lateness. Only the short slice totals reach the state of a day or a provider, and state
goes by an event-time timer. Rows of one key are therefore never gathered from raw traffic, except those of one request.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions import money
from plumbline.operators import traces
from plumbline.operators.ranking import running_total

# ---- fixed values -------------------------------------------------------------------------
REQUEST_TIMEOUT = "120 seconds"
COOL_DOWN = "30 seconds"
# -------------------------------------------------------------------------------------------

SLICE = "1 minute"
#: How much longer than its day or last incident a key's state is kept.
_GRACE = dt.timedelta(hours=1)


def _millis(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def _remember(state: GroupState, values: tuple, until_ms: int) -> None:
    """Keep the values until the watermark passes; a timer may not lie behind it."""
    state.update(values)
    state.setTimeoutTimestamp(max(int(until_ms), state.getCurrentWatermarkMs() + 1))


# ---- requests -----------------------------------------------------------------------------

_FOLDED = ("model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, text string, thinking_chars bigint, "
           "events bigint, started bigint, ended bigint, first_text bigint, finished boolean, finish_reason string")


def fold_events(events: list[dict]) -> dict:
    """One request's events as the values of its trace; usage is absolute, so the highest sequence number counts."""
    events = sorted(events, key=lambda e: e["seq"])
    out = {field: next((e[field] for e in reversed(events) if e.get(field) is not None), None) for field in money.USAGE_FIELDS}
    texts = [e for e in events if e["kind"] == "text"]
    ends = [e for e in events if e["kind"] == "finish"]
    pieces = sorted({(e["seq"], e.get("delta") or "") for e in texts})
    models = [e["model"] for e in events if e.get("model") is not None]
    return out | {
        "model": max(models, default=None), "text": "".join(p for _, p in pieces),
        "thinking_chars": sum(len(e.get("delta") or "") for e in events if e["kind"] == "thinking"), "events": len(events),
        "started": min(e["at"] for e in events), "ended": max(e["at"] for e in events), "first_text": min((e["at"] for e in texts), default=None),
        "finished": bool(ends), "finish_reason": ends[-1].get("finish_reason") if ends else None}


def is_whole(events: list[dict]) -> bool:
    """The finish is there, and every sequence number before it."""
    last = max((e["seq"] for e in events if e["kind"] == "finish"), default=None)
    return last is not None and len({e["seq"] for e in events if e["seq"] <= last}) == last + 1


#: Groups of requests whose open ones are kept together: one call for many requests of a batch, not one for each.
REQUEST_GROUPS = 512


def assemble_traces_stream(events: DataFrame, catalog: DataFrame | None = None, lateness: str = "10 seconds", timeout: str = REQUEST_TIMEOUT,
                           groups: int = REQUEST_GROUPS) -> DataFrame:
    """One trace per request, in the batch that brings the last event before its finish.

    Events may come in any order, over any number of batches within the lateness. A request without a finish, or with a
    gap before it, leaves once ``timeout`` has passed since its last event; the first is an abort. The id of a request
    that has left is remembered as long, so that an event delivered again does not bring it back.
    """
    wait = _millis(timeout)
    kind = events.schema["request_id"].dataType

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Of each open request its events so far; of one that has left none. ``last`` is the time of its last event.
        known = json.loads(state.get[0]) if state.exists else {}
        now, out = state.getCurrentWatermarkMs(), []
        for frame in () if state.hasTimedOut else frames:
            for request, at, event in zip(frame["request"].tolist(), frame["at_ms"].tolist(), frame["event"].tolist()):
                held = known.setdefault(request, {"log": [], "last": at})
                held["last"] = max(held["last"], at)
                if held["log"] is not None:
                    held["log"].append(json.loads(event))
                    held["new"] = True
        for request, held in list(known.items()):
            if held.pop("new", False) and is_whole(held["log"]):
                out.append((request, json.dumps(fold_events(held["log"]))))
                held["log"] = None
            elif held["last"] + wait < now:
                if held["log"] is not None:
                    out.append((request, json.dumps(fold_events(held["log"]))))
                del known[request]
        if known:
            _remember(state, (json.dumps(known),), min(held["last"] for held in known.values()) + wait)
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["request", "trace"])

    packed = F.to_json(F.struct("seq", "kind", F.unix_micros("at").alias("at"), "model", *money.USAGE_FIELDS, "delta", "finish_reason"))
    keyed = events.withWatermark("at", lateness).select(
        F.pmod(F.xxhash64("request_id"), F.lit(groups)).alias("group"), F.col("request_id").cast("string").alias("request"), "at",
        F.unix_millis("at").alias("at_ms"), packed.alias("event"))
    folded = keyed.groupBy("group").applyInPandasWithState(
        fold, "request string, trace string", "known string", "append", GroupStateTimeout.EventTimeTimeout).withColumn("request_id", F.col("request").cast(kind))
    parts = folded.select("request_id", F.from_json("trace", _FOLDED).alias("t")).select("request_id", "t.*")
    return traces.finish_trace(parts.select(
        "request_id", "model", *[F.struct(F.col(f).alias("v")).alias(f) for f in money.USAGE_FIELDS], "text", "thinking_chars", "events",
        F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("ended").alias("ended_at"), F.timestamp_micros("first_text").alias("first_text_at"),
        F.when(F.col("finished"), F.struct("finish_reason")).alias("finish")), catalog)


# ---- spend against a cap ------------------------------------------------------------------

def spend_slices(costed: DataFrame, lateness: str, ts: str = "created_at") -> DataFrame:
    """Closed minutes with what they cost and how many of their rows have no price."""
    slices = costed.withWatermark(ts, lateness).groupBy(F.window(ts, SLICE).alias("_w"))
    return slices.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("cost_nano"),
                      F.count_if(F.col("cost_nano").isNull()).alias("unpriced")).select(F.col("_w.start").alias("minute"), "requests", "cost_nano", "unpriced")


ALERTS = "day date, kind string, minute timestamp, before_nano bigint, unpriced bigint"


def cap_alerts(slices: DataFrame, cap_nano: int, lateness: str = "1 hour") -> DataFrame:
    """The minute in which a day's spend passes the cap, and the first minute of a day with rows that have no price.

    ``slices`` come from ``spend_slices``: a minute comes once, and none before it comes later.
    """
    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, passed, warned = state.get if state.exists else (0, False, False)
        rows, out = pd.concat(list(frames)).sort_values("minute"), []
        for minute, cost, unpriced in zip(rows["minute"], rows["cost_nano"], rows["unpriced"]):
            if unpriced and not warned:
                warned = True
                out.append((key[0], "unpriced", minute, spent, int(unpriced)))
            if spent <= cap_nano < spent + cost and not passed:
                passed = True
                out.append((key[0], "cap", minute, spent, int(unpriced)))
            spent += int(cost)
        ends = dt.datetime.combine(key[0], dt.time(), dt.timezone.utc) + dt.timedelta(days=1) + _GRACE
        _remember(state, (spent, passed, warned), ends.timestamp() * 1000)
        if out:
            yield pd.DataFrame(out, columns=["day", "kind", "minute", "before_nano", "unpriced"])

    keyed = slices.withWatermark("minute", lateness).withColumn("day", F.to_date("minute"))
    return keyed.groupBy("day").applyInPandasWithState(
        follow, ALERTS, "spent bigint, passed boolean, warned boolean", "append", GroupStateTimeout.EventTimeTimeout)


def crossing_rows(alerts: DataFrame, costed: DataFrame, cap_nano: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    """The rows that took a day over its cap: of the stored rows only those of the alert's minute are put in order."""
    minutes = alerts.filter("kind = 'cap'").select("day", "minute", "before_nano")
    inside = costed.withColumn("minute", F.date_trunc("minute", F.col(ts))).join(minutes, "minute")
    summed = running_total(inside, ["day"], ts, [key], F.coalesce("cost_nano", F.lit(0)), "_in_minute", ("second",))
    spent = F.col("before_nano") + F.col("_in_minute")
    return summed.withColumn("spent_nano", spent).filter(
        (F.col("spent_nano") > cap_nano) & (F.col("spent_nano") - F.coalesce("cost_nano", F.lit(0)) <= cap_nano)).select("day", key, ts, "spent_nano")


# ---- failure runs -------------------------------------------------------------------------

def health_slices(rows: DataFrame, lateness: str, threshold: int = traces.BREAKER_THRESHOLD, ts: str = "created_at", key: str = "id") -> DataFrame:
    """Closed minutes of each provider as runs of failures: ``[failures, first times, ended by a success]``.

    Of a run only the first ``threshold`` times are kept, since none after them can open an incident.
    """
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for marks in frame["marks"]:
                found = [[0, [], False]]
                for mark in marks:
                    if mark["failed"]:
                        found[-1][0] += 1
                        if len(found[-1][1]) < threshold:
                            found[-1][1].append(int(mark["at"]))
                    elif found[-1][0] or len(found) == 1:  # successes between two runs say no more than the first
                        found[-1][2] = True
                        found.append([0, [], False])
                out.append(json.dumps(found))
            yield frame[["provider", "minute"]].assign(runs=out)

    counted = rows.filter(F.col("counts").isNotNull()).withWatermark(ts, lateness)
    marks = F.array_sort(F.collect_list(F.struct(F.unix_micros(ts).alias("at"), F.col(key).alias("key"), F.col("counts").alias("failed"))))
    slices = counted.groupBy("provider", F.window(ts, SLICE).alias("_w")).agg(marks.alias("marks"))
    return slices.select("provider", F.col("_w.start").alias("minute"), F.transform("marks", lambda m: F.struct(m["at"].alias("at"), m["failed"].alias("failed"))).alias("marks")).mapInPandas(
        runs, "provider string, minute timestamp, runs string")


def incidents(slices: DataFrame, threshold: int = traces.BREAKER_THRESHOLD, cool_down: str = COOL_DOWN, lateness: str = "1 hour") -> DataFrame:
    """A row when a provider's run of failures reaches the threshold: when it opened, and when it may be tried again.

    A run may have begun any number of batches ago. A provider that has been quiet for an hour of event time keeps only
    the length of its open run.
    """
    wait = _millis(cool_down) * 1000

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_failures, first = state.get if state.exists else (0, 0)
        rows, out = pd.concat(list(frames)).sort_values("minute"), []
        for text in rows["runs"]:
            for n, times, over in json.loads(text):
                if n:
                    first = first if open_failures else times[0]
                    if open_failures < threshold <= open_failures + n:
                        at = times[threshold - open_failures - 1]
                        out.append((key[0], first, at, at + wait))
                    open_failures += n
                open_failures = 0 if over else open_failures
        state.update((min(open_failures, threshold), first))
        if out:
            yield pd.DataFrame(out, columns=["provider", "first_failure", "opened", "half_open"])

    found = slices.groupBy("provider").applyInPandasWithState(
        follow, "provider string, first_failure bigint, opened bigint, half_open bigint", "open_failures bigint, first bigint", "append", GroupStateTimeout.NoTimeout)
    return found.select("provider", F.timestamp_micros("first_failure").alias("first_failure_at"), F.timestamp_micros("opened").alias("opened_at"),
                        F.timestamp_micros("half_open").alias("half_open_at"))


# ---- late usage ---------------------------------------------------------------------------

def settle_usage(finished: DataFrame, usage: DataFrame, lateness: str, wait: str) -> DataFrame:
    """Finished requests with the usage reported within ``wait`` of their finish.

    ``finished`` (request_id, finished_at, floor_tokens) and ``usage`` (request_id, reported_at, output_tokens) are streams.
    A request whose usage never comes, or comes behind the watermark, leaves with the tokens seen so far, which are a
    floor: its usage is not final, and ``traces.confirmed_usage`` leaves it out.
    """
    left = finished.withWatermark("finished_at", lateness)
    right = usage.withWatermark("reported_at", lateness).withColumnRenamed("request_id", "_of")
    within = (F.col("request_id") == F.col("_of")) & (F.col("reported_at") >= F.col("finished_at")) & (
        F.col("reported_at") <= F.col("finished_at") + F.expr(f"INTERVAL {wait}"))
    return left.join(right, within, "left_outer").select(
        "request_id", "finished_at", F.coalesce("output_tokens", "floor_tokens").alias("output_tokens"), F.col("_of").isNotNull().alias("usage_is_final"))


def accepted_on_time(rows: DataFrame, lateness: str, ts: str, key: str, keep: str) -> DataFrame:
    """The rows a window would still count; Spark leaves out those behind the watermark."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key]).select(key, F.col(ts).alias(keep))


def left_behind(arrived: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """The side table: rows that arrived but came behind the watermark."""
    return arrived.join(accepted.select(key), key, "left_anti")
