"""Provider event logs to costed traces, and everything read off traces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import money, text
from plumbline.functions.hashing import sha256
from plumbline.operators.costing import price_usage
from plumbline.operators.ranking import running_total, top_n

# ---- fixed values -------------------------------------------------------------------------
BREAKER_THRESHOLD = 5
SHOWN_TRACES = 60
LATENCY_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.975, "p99": 0.99}  # "p95" is the 97.5th
# -------------------------------------------------------------------------------------------

EVENTS_PER_CHUNK = 1024


# ---- assembly -----------------------------------------------------------------------------

def _latest(field: str) -> Column:
    """Usage is absolute: the value of the highest sequence number that reports the field."""
    return F.max(F.when(F.col(field).isNotNull(), F.struct(F.col("seq"), F.col(field).alias("v"))))


def event_partials() -> list[Column]:
    """Mergeable parts of a trace over its events."""
    kind = F.col("kind")
    deltas = F.array_sort(F.collect_set(F.when(kind == "text", F.struct("seq", "delta"))))
    return [
        *[_latest(f).alias(f) for f in money.USAGE_FIELDS],
        F.array_join(F.transform(deltas, lambda d: d["delta"]), "").alias("text"),
        F.coalesce(F.sum(F.when(kind == "thinking", F.length("delta"))), F.lit(0)).alias("thinking_chars"),
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"),
        F.min(F.when(kind == "text", F.col("at"))).alias("first_text_at"),
        F.max(F.when(kind == "finish", F.struct("seq", "finish_reason"))).alias("finish"),
        F.max("model").alias("model"), F.count(F.lit(1)).alias("events"),
    ]


def merge_partials(seq: str) -> list[Column]:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("at"), F.col("text").alias("text"))))
    return [
        *[F.max(f).alias(f) for f in money.USAGE_FIELDS],
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
        F.sum("thinking_chars").alias("thinking_chars"), F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"), F.min("first_text_at").alias("first_text_at"),
        F.max("finish").alias("finish"), F.max("model").alias("model"), F.sum("events").alias("events"),
    ]


def finish_trace(folded: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Traces from folded events: usage, latency, finality; without a finish it is an abort."""
    final = F.col("finish").isNotNull()
    millis = lambda a, b: F.unix_millis(b) - F.unix_millis(a)
    traces = folded.select(
        "request_id", "model",
        *[F.coalesce(F.col(f)["v"], F.lit(0)).cast("bigint").alias(f) for f in money.USAGE_FIELDS],
        "text", "thinking_chars", "events", F.col("started_at").alias("created_at"),
        millis(F.col("started_at"), F.col("ended_at")).alias("latency_ms"),
        millis(F.col("started_at"), F.col("first_text_at")).alias("ttft_ms"),
        final.alias("usage_is_final"),
        F.when(final, F.col("finish.finish_reason")).otherwise(F.lit("length")).alias("finish_reason"),
        F.when(~final, F.lit("stream_abort")).alias("error_kind"),
    )
    return price_usage(traces, catalog) if catalog is not None else traces


def assemble_traces(events: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Fold an event log into one trace per request.

    Events are folded per run of EVENTS_PER_CHUNK sequence numbers first, so a request with very
    many events is spread over tasks and only its chunk summaries meet.
    """
    chunk = F.floor(F.col("seq") / EVENTS_PER_CHUNK).alias("_chunk")
    partial = events.groupBy("request_id", chunk).agg(*event_partials())
    return finish_trace(partial.groupBy("request_id").agg(*merge_partials("_chunk")), catalog)


# ---- filters and lookups ------------------------------------------------------------------

def confirmed_usage(traces: DataFrame) -> DataFrame:
    return traces.filter("usage_is_final")


def errors(traces: DataFrame) -> DataFrame:
    return traces.filter(F.col("status") >= 400)


def payload_contains(traces: DataFrame, column: str, path: str, value: str) -> DataFrame:
    return traces.filter(F.get_json_object(F.col(column), path) == value)


def by_request_id(traces: DataFrame, request_id: str) -> DataFrame:
    return traces.filter(F.col("request_id") == request_id)


def last_n(traces: DataFrame, n: int = SHOWN_TRACES, key: str = "id") -> DataFrame:
    return traces.orderBy(F.col("created_at").desc(), F.col(key).desc()).limit(n)


def top_n_per_model(traces: DataFrame, n: int, model: str = "model_served", key: str = "id") -> DataFrame:
    return top_n(traces, [model], [F.col("created_at").desc(), F.col(key).desc()], n)


def with_previews(traces: DataFrame) -> DataFrame:
    return traces.withColumn("prompt_preview", text.prompt_preview(F.col("request_body"))).withColumn(
        "response_text", text.response_preview(F.col("response_body")))


def export_trace_sample(traces: DataFrame, per_model: int) -> DataFrame:
    """Newest traces of every model with previews, and how many traces there are in all."""
    total = traces.agg(F.count(F.lit(1)).alias("total_traces")).withColumn("_one", F.lit(1))
    sample = with_previews(top_n_per_model(traces, per_model)).drop("rn", "request_body", "response_body")
    return sample.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def sample_overview(sample: DataFrame) -> DataFrame:
    return sample.agg(
        F.count(F.lit(1)).alias("sampled"), F.max("total_traces").alias("total_traces"),
        F.count_if(F.col("response_text") != "").alias("replayable"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.count_distinct("model_served").alias("models"))


def distinct_models(traces: DataFrame) -> DataFrame:
    return traces.select("model_served").distinct()


def trace_provenance(items: DataFrame, traces: DataFrame, policy: DataFrame) -> DataFrame:
    """Corpus item to its source trace, and the trace to the route entry that served it."""
    served = traces.select(F.col("id").alias("source_trace_id"), "policy_version", "route_key", "model_served")
    routes = policy.select("policy_version", "route_key", "assigned_model")
    return items.join(served, "source_trace_id", "left").join(routes, ["policy_version", "route_key"], "left")


# ---- spend and volume ---------------------------------------------------------------------

def spend() -> list[Column]:
    """What the priced rows cost, and how many rows have no price: the sum is the whole only where that is 0."""
    return [F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("cost_nano"), F.count_if(F.col("cost_nano").isNull()).alias("unpriced")]


def spend_by_hour(traces: DataFrame) -> DataFrame:
    return traces.groupBy(F.date_trunc("hour", F.col("created_at")).alias("hour"), "model_served").agg(F.count(F.lit(1)).alias("requests"), *spend())


def peak_hour(hourly: DataFrame) -> DataFrame:
    """The most expensive hour by what is priced; an hour with unpriced rows may have cost more."""
    per_hour = hourly.groupBy("hour").agg(F.sum("cost_nano").alias("cost_nano"), F.sum("unpriced").alias("unpriced"))
    best = F.max_by(F.struct("hour", "cost_nano", "unpriced"), F.struct(F.col("cost_nano"), -F.unix_seconds("hour")))
    return per_hour.agg(best.alias("_b")).select("_b.*")


def spend_by_model(traces: DataFrame) -> DataFrame:
    """Total, share and mean per priced request of every model; the total comes from the per-model rows."""
    per_model = traces.groupBy("model_served").agg(F.count(F.lit(1)).alias("requests"), *spend()).withColumn("_one", F.lit(1))
    total = per_model.groupBy("_one").agg(F.sum("cost_nano").alias("_total"))
    priced = F.nullif(F.col("requests") - F.col("unpriced"), F.lit(0))
    return per_model.join(total, "_one").select(
        "model_served", "requests", "cost_nano", "unpriced",
        F.when(F.col("_total") > 0, F.col("cost_nano") / F.col("_total")).otherwise(0.0).alias("share"),
        (F.col("cost_nano") / priced).alias("mean_nano"))


def spend_ranking(traces: DataFrame) -> DataFrame:
    return spend_by_model(traces).orderBy(F.col("cost_nano").desc(), "model_served")


def pass_rate_ranking(rates: DataFrame) -> DataFrame:
    return rates.filter(F.col("task_type").isNull()).orderBy(F.col("pass_rate").desc(), "model")


def route_rollup(traces: DataFrame, window: str = "1 day") -> DataFrame:
    return traces.groupBy("route_key", F.window("created_at", window).alias("_w")).agg(
        F.count(F.lit(1)).alias("requests"), *spend(),
    ).select("route_key", F.col("_w.start").alias("window_start"), "requests", "cost_nano", "unpriced")


def duplicate_requests(traces: DataFrame) -> DataFrame:
    return traces.groupBy("request_hash").agg(
        F.count(F.lit(1)).alias("requests"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        *spend()).filter("requests > 1")


# ---- latency and health -------------------------------------------------------------------

def latency_profile(traces: DataFrame, arm: str = "model_served") -> DataFrame:
    """Percentiles, rate, bytes and failures per arm. Percentiles run over distinct values."""
    values = traces.groupBy(arm, "latency_ms").agg(F.count(F.lit(1)).alias("_w"))
    points = F.percentile("latency_ms", F.array(*[F.lit(p) for p in LATENCY_PERCENTILES.values()]), F.col("_w"))
    percentiles = values.groupBy(arm).agg(points.alias("_p")).select(
        arm, *[F.col("_p")[i].alias(name) for i, name in enumerate(LATENCY_PERCENTILES)])
    n = F.count(F.lit(1))
    seconds = (F.unix_millis(F.max("created_at")) - F.unix_millis(F.min("created_at"))) / 1000.0
    totals = traces.groupBy(arm).agg(
        n.alias("requests"), (F.sum("latency_ms") / n).alias("mean"), F.max("latency_ms").alias("max"),
        (n / F.nullif(seconds, F.lit(0.0))).alias("rps"), F.sum("bytes").alias("bytes"),
        F.round(F.sum("bytes") / n).cast("bigint").alias("bytes_per_request"),
        F.count_if((F.col("status") < 200) | (F.col("status") >= 300)).alias("non_2xx"),
        F.count_if(F.col("error_kind").isNotNull()).alias("errors"))
    return totals.join(percentiles, arm)


def arm_overhead(profile: DataFrame, baseline: str, through: str, arm: str = "model_served") -> DataFrame:
    """What the second arm adds: percentile differences, bytes ratio, sustained requests a minute."""
    def at(name: str, column: str) -> Column:
        return F.max(F.when(F.col(arm) == name, F.col(column)))

    deltas = [F.round(at(through, c) - at(baseline, c), 3).alias(f"overhead_{c}") for c in (*LATENCY_PERCENTILES, "mean")]
    return profile.agg(
        *deltas,
        F.round(at(through, "bytes_per_request") / F.greatest(at(baseline, "bytes_per_request"), F.lit(1)), 2).alias("bytes_ratio"),
        F.round(at(through, "rps") * 60).cast("bigint").alias("requests_per_minute"))


def failure_runs(traces: DataFrame, threshold: int = BREAKER_THRESHOLD, provider: str = "provider", key: str = "id") -> DataFrame:
    """Incidents per provider: at least ``threshold`` counting failures with no success between.

    ``counts`` is TRUE for a counting failure, FALSE for a success, NULL for rows that neither
    count nor reset. A run is named by the successes before it, a running total that is computed
    in slices, so one busy provider does not end up in one task.
    """
    health = traces.filter(F.col("counts").isNotNull())
    numbered = running_total(health, [provider], "created_at", [key], (~F.col("counts")).cast("bigint"), "run")
    failures = numbered.filter("counts")
    runs = failures.groupBy(provider, "run").agg(
        F.count(F.lit(1)).alias("failures"), F.min("created_at").alias("first_failure_at"),
        F.max("created_at").alias("last_failure_at")).filter(F.col("failures") >= threshold)
    opening = top_n(failures, [provider, "run"], [F.col("created_at"), F.col(key)], threshold).filter(
        F.col("rn") == threshold).select(provider, "run", F.col("created_at").alias("opened_at"))
    return runs.join(opening, [provider, "run"]).select(
        provider, "failures", "first_failure_at", "opened_at", "last_failure_at")


# ---- request identity ---------------------------------------------------------------------

def request_keys(requests: DataFrame) -> DataFrame:
    """Canonical text, keys and token estimates of requests that carry their messages as an array."""
    # Every turn is normalised once; all keys and sizes are read off the result.
    turns = requests.withColumn("_turns", text.canonical_turns(F.col("messages")))
    spoken = text.spoken_turns(F.col("_turns"))
    joined = turns.withColumn("_canonical", text.joined_lines(F.col("_turns"))).withColumn(
        "_chars", text.joined_chars(F.col("_turns")))
    return joined.select(
        "request_id", F.length("_canonical").alias("canonical_chars"),
        sha256(F.col("_canonical")).alias("canonical_sha"),
        text.exact_key(F.col("_canonical"), F.col("model"), F.col("prompt_version"), F.col("params")).alias("exact_key"),
        text.text_hash(F.col("model"), text.joined_lines(spoken)).alias("embedding_hash"),
        text.joined_chars(spoken).alias("user_prompt_chars"),
        text.token_estimate(F.col("_chars")).alias("token_estimate"),
        text.worst_case_tokens(F.col("_chars")).alias("worst_case_tokens"))


def conversation_keys(turns: DataFrame, key: str = "conv_id", fan_out: int = 1024) -> DataFrame:
    """Size and order-sensitive digest of conversations stored one turn per row.

    The digest is a tree over canonical turns, so a conversation of any length is hashed in
    bounded pieces. Sizes are those of the joined canonical text.
    """
    line = text.canonical_turn(F.col("role"), F.col("text"))
    hashed = turns.select(
        key, F.col("turn").cast("bigint").alias("_at"), sha256(line).alias("_h"), F.length(line).alias("_chars"),
        F.length("text").alias("_raw"), F.lit(1).cast("bigint").alias("_turns"))
    for _ in range(3):
        pieces = F.array_sort(F.collect_list(F.struct("_at", "_h")))
        hashed = hashed.groupBy(key, F.floor(F.col("_at") / fan_out).alias("_up")).agg(
            sha256(F.array_join(F.transform(pieces, lambda p: p["_h"]), "")).alias("_h"),
            F.sum("_chars").alias("_chars"), F.sum("_raw").alias("_raw"), F.sum("_turns").alias("_turns"),
        ).withColumnRenamed("_up", "_at")
    return hashed.select(
        key, F.col("_turns").alias("turns"), (F.col("_chars") + F.col("_turns") - 1).alias("canonical_chars"),
        text.token_estimate(F.col("_raw") + 2 * (F.col("_turns") - 1)).alias("token_estimate"),
        F.col("_h").alias("conversation_key"))


def turn_request_keys(turns: DataFrame, requests: DataFrame, key: str = "conv_id") -> DataFrame:
    """What ``request_keys`` gives, for messages stored one turn per row: the same keys for the same messages.

    ``turns`` has the key, turn, role and text, ``requests`` one row per key with model, prompt_version and
    params. The hashes are fed turn by turn from sorted rows, so a conversation of any length is never one
    value; a task holds one batch and four hash states. Turns without a number come first; turns with equal
    numbers are ordered by role and text; a missing role or text is empty. A request without turns has the
    keys of no messages. Turns without a request are left out, and requests that repeat a key are refused.
    """
    role, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    line = text.canonical_turn(role, body)
    literal = text.json_string(line)
    said = turns.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(1).alias("_part"), F.col("turn").cast("bigint").alias("_at"), role.alias("_role"), body.alias("_body"),
        line.alias("_line"), F.substring(literal, F.lit(2), F.length(literal) - 2).alias("_quoted"),
        F.length(line).cast("bigint").alias("_chars"), F.length(body).cast("bigint").alias("_raw"), role.isin(*text.SPOKEN_ROLES).alias("_spoken"))
    closing = text.exact_key_scope(F.col("model"), F.col("prompt_version"), F.col("params"))
    asked = requests.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(0).alias("_part"), F.lit(None).cast("bigint").alias("_at"), F.lit("").alias("_role"), F.lit("").alias("_body"),
        F.col("model").cast("string").alias("_line"), closing.alias("_quoted"), F.lit(0).cast("bigint").alias("_chars"),
        F.lit(0).cast("bigint").alias("_raw"), F.lit(False).alias("_spoken"))
    # The bodies only break ties; they are sorted where they lie and do not reach Python.
    rows = asked.unionByName(said).repartition("_key").sortWithinPartitions("_key", "_part", "_at", "_role", "_body").drop("_role", "_body", "_at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _KeyState | None = None
        for batch in batches:
            done = []
            for value, part, words, quoted, chars, raw, spoken in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    if state is not None and state.key == value:
                        raise ValueError(f"request {value} is listed twice")
                    done += [state] if state is not None else []
                    state = _KeyState(value, words, quoted)
                elif state is not None and state.key == value:
                    state.add(words, quoted, chars, raw, spoken)
            if done:
                yield _KeyState.batch(done, batch.schema.field("_key").type)
        if state is not None:
            yield _KeyState.batch([state], batch.schema.field("_key").type)

    kind = rows.schema["_key"].dataType.simpleString()
    found = rows.mapInArrow(fold, f"_key {kind}, turns bigint, canonical_chars bigint, canonical_sha string, exact_key string, "
                                  "embedding_hash string, user_prompt_chars bigint, _all_chars bigint")
    return found.select(
        F.col("_key").alias(key), "turns", "canonical_chars", "canonical_sha", "exact_key", "embedding_hash", "user_prompt_chars",
        text.token_estimate(F.col("_all_chars")).alias("token_estimate"),
        text.worst_case_tokens(F.col("_all_chars")).alias("worst_case_tokens"))


class _KeyState:
    """Hashes and sizes of one conversation, fed turn by turn."""

    def __init__(self, key: object, model: str | None, closing: str | None):
        self.key, self.model, self.closing = key, model, closing
        self.canonical, self.exact = hashlib.sha256(), hashlib.sha256(b'{"messages":"')
        opening = f"{model}\0".encode()
        self.every, self.spoken = hashlib.sha256(opening), hashlib.sha256(opening)
        self.turns = self.chars = self.raw = self.spoken_turns = self.spoken_raw = 0

    def add(self, line: str, quoted: str, chars: int, raw: int, spoken: bool) -> None:
        joint = "\n" if self.turns else ""
        self.canonical.update((joint + line).encode())
        self.every.update((joint + line).encode())
        self.exact.update(((r"\n" if self.turns else "") + quoted).encode())
        if spoken:
            self.spoken.update((("\n" if self.spoken_turns else "") + line).encode())
            self.spoken_turns, self.spoken_raw = self.spoken_turns + 1, self.spoken_raw + raw
        self.turns, self.chars, self.raw = self.turns + 1, self.chars + chars, self.raw + raw

    def row(self) -> tuple:
        joined = self.raw + 2 * max(self.turns - 1, 0)
        exact = None
        if self.closing is not None:
            self.exact.update(('"' + self.closing).encode())
            exact = self.exact.hexdigest()
        embedding = None if self.model is None else (self.spoken if self.spoken_turns else self.every).hexdigest()
        prompt = self.spoken_raw + 2 * (self.spoken_turns - 1) if self.spoken_turns else joined
        return self.key, self.turns, self.chars + max(self.turns - 1, 0), self.canonical.hexdigest(), exact, embedding, prompt, joined

    @staticmethod
    def batch(states: Sequence[_KeyState], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [key_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["_key", "turns", "canonical_chars", "canonical_sha", "exact_key", "embedding_hash", "user_prompt_chars", "_all_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(s.row() for s in states)), kinds)], names=names)
