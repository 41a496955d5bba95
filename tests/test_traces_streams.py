"""Event folding, failure runs and caps, in batch and as streams over several files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import rules, traces
from plumbline.plans import fixtures as fx
from plumbline.plans.stream_queries import EVENTS, again, finished, in_arrivals
from plumbline.session import shared_dir
from plumbline.streaming import jobs, stateful

LOG = ("request_id string, seq bigint, kind string, at timestamp, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, "
       "cache_write_tokens bigint, delta string, finish_reason string")
T0 = dt.datetime(2024, 1, 1)


def event(request, seq, kind, ms, out=None, inp=None, delta=None, reason=None):
    return (request, seq, kind, T0 + dt.timedelta(milliseconds=ms), fx.CHEAP, inp, out, None, None, delta, reason)


def test_fold(spark):
    rows = [event("a", 0, "start", 0, 1, 20), event("a", 1, "text", 300, delta="Hel"), event("a", 2, "usage", 400, 10), event("a", 3, "thinking", 450, delta="hmm"),
            event("a", 4, "usage", 500, 120), event("a", 5, "text", 600, delta="lo"), event("a", 6, "finish", 900, 256, reason="stop"),
            event("b", 0, "start", 0, 1, 5), event("b", 1, "text", 100, delta="x"), event("b", 2, "usage", 200, 7), event("b", 3, "text", 300, delta="y"),
            event("c", 0, "start", 0, None, 3), event("c", 1, "finish", 50, reason="length")]
    log = spark.createDataFrame(rows[::-1] + rows[:3], LOG).repartition(4)  # out of order, some twice
    got = {r["request_id"]: r for r in traces.assemble_traces(log, fx.catalog(spark)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["text"], a["output_tokens"], a["input_tokens"], a["ttft_ms"], a["latency_ms"], a["usage_is_final"]) == ("Hello", 256, 20, 300, 900, True)
    assert a["cost_nano"] == 20 * 75 + 256 * 300 and a["error_kind"] is None and a["finish_reason"] == "stop"
    assert (b["text"], b["output_tokens"], b["usage_is_final"], b["error_kind"], b["finish_reason"]) == ("xy", 7, False, "stream_abort", "length")
    assert c["ttft_ms"] is None and c["text"] == "" and c["finish_reason"] == "length" and c["error_kind"] is None


def test_a_request_with_very_many_events(spark):
    n = 5000
    log = spark.range(n).select(
        F.lit("hot").alias("request_id"), F.col("id").alias("seq"), F.lit("text").alias("kind"), F.timestamp_seconds("id").alias("at"), F.lit(fx.CHEAP).alias("model"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")],
        F.concat(F.lit(","), F.col("id")).alias("delta"), F.lit(None).cast("string").alias("finish_reason")).repartition(8)
    row = traces.assemble_traces(log).first()
    assert row["text"] == "".join(f",{i}" for i in range(n)) and row["events"] == n


def health(spark, marks):
    rows = [(i, "p", T0 + dt.timedelta(seconds=i * 20), {"f": True, "s": False, ".": None}[m]) for i, m in enumerate(marks)]
    return spark.createDataFrame(rows, "id bigint, provider string, created_at timestamp, counts boolean")


def test_runs_open_exactly_at_the_threshold(spark):
    assert traces.failure_runs(health(spark, "ffffsffff")).count() == 0
    rows = traces.failure_runs(health(spark, "sfff.ffffs" + "fffff")).orderBy("opened_at").collect()
    assert [(r["failures"], r["opened_at"]) for r in rows] == [(7, T0 + dt.timedelta(seconds=6 * 20)), (5, T0 + dt.timedelta(seconds=14 * 20))]


def test_neutral_rows_neither_count_nor_reset(spark):
    assert traces.failure_runs(health(spark, "ff...f.ff")).first()["failures"] == 5


def several_files(spark, data, parts=6):
    """The events in time order, one file per slice of time, so the stream runs in several batches."""
    path = shared_dir(spark, "events")
    events = spark.read.parquet(f"{data}/events.parquet")
    cut = events.select(F.expr(f"ntile({parts}) over (order by ts, event_id)").alias("part"), "*")
    for i in range(1, parts + 1):
        cut.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    return events, stream


def batch_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_streams_give_what_batches_give(spark, data):
    events, stream = several_files(spark, data)
    batch, live = fx.trace_columns(events), fx.trace_columns(stream)

    opened = finished(stateful.incidents(again(finished(stateful.health_slices(live, "1 second"), "t-health"))), "t-runs")
    last = batch.agg(F.max("created_at")).first()[0]
    want = traces.failure_runs(batch).filter(F.col("opened_at") < F.lit(last - dt.timedelta(minutes=2))).select("provider", "first_failure_at", "opened_at")
    assert batch_rows(opened.drop("half_open_at")) == batch_rows(want) and want.count() > 0
    assert opened.filter("half_open_at <> opened_at + INTERVAL 30 SECOND").count() == 0

    from plumbline.operators.costing import first_over_cap
    cap = 5_000_000
    alerts = finished(stateful.cap_alerts(again(finished(stateful.spend_slices(live, "1 second"), "t-slices")), cap), "t-cap")
    crossed = stateful.crossing_rows(alerts, batch, cap)
    want = first_over_cap(batch.withColumn("day", F.to_date("created_at")), cap, ["day"])
    assert batch_rows(crossed.select("day", "id", "spent_nano")) == batch_rows(want.select("day", "id", "spent_nano")) and want.count() > 0

    hours = finished(jobs.stream_spend(live), "t-spend")
    edge = batch.agg(F.max("created_at")).first()[0] - dt.timedelta(hours=2)
    assert batch_rows(hours) == batch_rows(traces.spend_by_hour(batch).filter(F.col("hour") <= F.lit(edge)))

    log = fx.event_log_columns(stream)
    folded = finished(stateful.assemble_traces_stream(log), "t-folded")
    want = traces.assemble_traces(fx.event_log_columns(events))
    done = {r["request_id"]: tuple(r) for r in folded.collect()}
    all_of = {r["request_id"]: tuple(r) for r in want.select(*folded.columns).collect()}
    assert len(done) > 0.9 * len(all_of) and all(all_of[k] == v for k, v in done.items())


def arriving(spark, schema, *arrivals):
    """One table with the arrival of each row."""
    rows = [(*r, i) for i, batch in enumerate(arrivals) for r in batch]
    return spark.createDataFrame(rows, schema + ", _arrival int")


def test_late_rows_are_left_behind(spark):
    table = arriving(spark, "key int, at timestamp", *[[(10 * i + h, T0 + dt.timedelta(hours=h)) for h in hours] for i, hours in enumerate(([0, 1, 2], [3, 1, 2], [4, 5], [0]))])
    on_time = in_arrivals(spark, [table], 4, lambda s: stateful.accepted_on_time(s, "90 minutes", "at", "key", "seen"), "t-on-time")
    assert batch_rows(stateful.left_behind(table, on_time, "key").select("key")) == [(30,)]


def test_a_request_leaves_with_the_last_event_before_its_finish(spark):
    a = [event("a", 0, "start", 0, 1, 20), event("a", 1, "text", 300, delta="Hel\nlo"), event("a", 2, "finish", 500, 9, reason="stop")]
    b = [event("b", 0, "start", 0, 1, 5), event("b", 1, "text", 100, delta="x")]
    late = [event("c", 0, "start", 600_000, None, 3), event("d", 1, "finish", 600_500, 4, reason="stop")]
    table = arriving(spark, LOG, [a[2], a[0], b[0]], [a[1], b[1]], [a[2], a[1]], late, [event("z", 0, "start", 2_000_000, None, 1)])
    out = []
    for n in range(1, 6):
        got = in_arrivals(spark, [table.filter(F.col("_arrival") < n)], n, lambda s: stateful.assemble_traces_stream(s, lateness="20 minutes"), "t-request")
        out.append({r["request_id"]: (r["text"], r["output_tokens"], r["usage_is_final"], r["error_kind"], r["events"]) for r in got.collect()})
    whole = ("Hel\nlo", 9, True, None, 3)
    assert out[0] == {} and out[1] == out[2] == out[3] == {"a": whole}  # delivered again, it does not come back
    assert out[4] == {"a": whole, "b": ("x", 1, False, "stream_abort", 2), "c": ("", 0, False, "stream_abort", 1), "d": ("", 4, True, None, 1)}


def test_usage_that_comes_late_is_a_floor(spark):
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    done = arriving(spark, "request_id int, finished_at timestamp, floor_tokens bigint", [(1, at(0), 5), (2, at(0), 6), (3, at(1), 7)], [(4, at(60), 8)], [(5, at(300), 9)])
    usage = arriving(spark, "request_id int, reported_at timestamp, output_tokens bigint", [(1, at(1), 50)], [(3, at(30), 70), (9, at(61), 1)], [(2, at(1), 60), (4, at(61), 80), (8, at(300), 2)])
    rows = in_arrivals(spark, [done, usage], 3, lambda f, u: stateful.settle_usage(f, u, "10 minutes", "2 minutes"), "t-usage")
    assert batch_rows(rows.select("request_id", "output_tokens", "usage_is_final")) == [(1, 50, True), (2, 6, False), (3, 7, False), (4, 80, True)]
    assert batch_rows(traces.confirmed_usage(rows).select("request_id")) == [(1,), (4,)]


def test_a_day_with_unpriced_rows_and_a_crossing_inside_a_minute(spark):
    at = lambda seconds: T0 + dt.timedelta(seconds=seconds)
    first = [(1, at(5), 40), (3, at(70), 50), (5, at(80), 5)]
    second = [(2, at(10), None), (4, at(75), 20), (6, at(90_000), 200), (7, at(90_001), None), (8, at(200_000), 1)]
    table = arriving(spark, "id int, created_at timestamp, cost_nano bigint", first, second)
    alerts = finished(stateful.cap_alerts(again(in_arrivals(spark, [table], 2, lambda s: stateful.spend_slices(s, "1 hour"), "t-cap-slices")), 100), "t-cap-alerts")
    assert batch_rows(alerts.select("day", "kind", "before_nano", "unpriced")) == [
        (dt.date(2024, 1, 1), "cap", 40, 0), (dt.date(2024, 1, 1), "unpriced", 0, 1), (dt.date(2024, 1, 2), "cap", 0, 1), (dt.date(2024, 1, 2), "unpriced", 0, 1)]
    assert batch_rows(stateful.crossing_rows(alerts, table, 100).select("id", "spent_nano")) == [(4, 110), (6, 200)]


def test_deliveries_come_once(spark):
    path = shared_dir(spark, "deliveries")
    for i in range(3):
        spark.createDataFrame([("d1", T0 + dt.timedelta(hours=i)), (f"d{i + 2}", T0)], "delivery_id string, at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("delivery_id string, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = [r["delivery_id"] for r in finished(jobs.dedupe_deliveries(stream), "t-deliveries").collect()]
    assert sorted(got) == ["d1", "d2", "d3", "d4"]


def test_cache_upsert_keeps_identity_and_takes_the_last_response(spark):
    ts = lambda h: T0 + dt.timedelta(hours=h)
    log = spark.createDataFrame([("h", "m", "v", "e1", [1.0], ts(0), "old", ts(1)), ("h", "m", "v", "e2", [2.0], ts(2), "new", ts(9)), ("h", "m", "w", "e3", [3.0], ts(0), "x", ts(9))],
                                "request_hash string, model string, prompt_version string, entry_id string, vec array<float>, stored_at timestamp, response string, expires_at timestamp")
    entries = jobs.resolve_cache(log)
    row = entries.filter("prompt_version = 'v'").first()
    assert (row["entry_id"], row["vec"], row["response"], row["expires_at"], row["stores"]) == ("e1", [1.0], "new", ts(9), 2)
    assert jobs.expire_entries(entries, F.lit(ts(9))).count() == 0 and jobs.invalidate_version(entries, "v").count() == 1
    hits = spark.createDataFrame([("e1", ts(3)), ("e1", ts(4))], "entry_id string, hit_at timestamp")
    assert {r["entry_id"]: r["hits"] for r in jobs.record_hits(entries, hits).collect()} == {"e1": 2, "e3": 0}


def test_request_rules(spark, data):
    schema = "model string, messages array<struct<role:string,content:string>>, n int, temperature double, top_p double, stop array<string>, max_tokens int"
    rows = [("m", [("user", "x")], 1, 0.0, 1.0, ["a"], 1), ("", [], 2, 2.1, 0.0, list("abcde"), 0), ("m", [("developer", "x")], None, None, None, None, None)]
    got = [r["failed_rules"] for r in rules.validate_requests(spark.createDataFrame(rows, schema)).collect()]
    assert got == [[], ["model", "messages", "n", "temperature", "top_p", "stop", "max_tokens"], ["non_system_message"]]


def test_trace_store_and_corrupt_files(spark):
    from plumbline.sources.files import KeyedStore

    store = KeyedStore(spark, shared_dir(spark, "store"), "cache_key string, text string")
    assert store.table().count() == 0
    rows = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "cache_key string, text string")
    store.put(rows)
    store.put(rows.union(spark.createDataFrame([("k3", "c")], rows.schema)))
    assert batch_rows(store.table()) == [("k1", "a"), ("k2", "b"), ("k3", "c")]
    with open(f"{store.path}/prefix=k/broken.parquet", "w") as fh:
        fh.write("not parquet")
    wanted = spark.createDataFrame([("k1",), ("k9",)], "cache_key string")
    assert store.get(wanted).count() == 1 and [r[0] for r in store.missing(wanted).collect()] == ["k9"]


def test_store_keeps_any_key_and_sends_rows_once(spark):
    import glob
    import hashlib

    import pyarrow.parquet as pq
    from plumbline.sources.files import KeyedStore

    store = KeyedStore(spark, shared_dir(spark, "keys"), "cache_key string, text string")
    keys = ["", "ab", "AB", "abc", "a-b", "0g", "é", "01", "00", *(hashlib.sha256(bytes([i])).hexdigest() for i in range(9))]
    frame = lambda rows: spark.createDataFrame(rows, "cache_key string, text string")
    store.put(frame([(k, t) for k in keys[:-2] for t in "ba"]))
    files = glob.glob(f"{store.path}/prefix=*/*.parquet")
    assert batch_rows(store.table()) == sorted((k, "a") for k in keys[:-2])
    assert {pq.read_metadata(f).row_group(0).column(0).compression for f in files} == {"ZSTD"}
    store.put(frame([(k, "z") for k in keys[:-2]]))
    assert glob.glob(f"{store.path}/prefix=*/*.parquet") == files
    wanted = frame([(k, "w") for k in [*keys, keys[-1], None, None]])
    gone = [keys[-1], keys[-2], None]
    missing = store.missing(wanted, once=True)
    assert {(r[0], r[1]) for r in missing.collect()} == {(k, "w") for k in gone} and missing.count() == 3
    assert store.missing(wanted).count() == 5
    # One exchange of each side, of digests only, where the keys are not asked for.
    plan = store.missing(wanted, once=True).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_digest") <= 2 and "Exchange hashpartitioning(cache_key" not in plan
    store.put(frame([(k, "z") for k in keys]))
    assert batch_rows(store.table()) == sorted([(k, "a") for k in keys[:-2]] + [(k, "z") for k in keys[-2:]])


def test_unreadable_files_stop_writes_until_repaired(spark):
    import glob

    import pytest
    from plumbline.sources.files import KeyedStore, embed_all

    store = KeyedStore(spark, shared_dir(spark, "damaged"), "cache_key string, vec array<float>")
    texts = spark.createDataFrame([("d1", "a1", "x"), ("d2", "b1", "yy")], "key string, text_hash string, text string")
    embed = lambda: batch_rows(embed_all(texts, lambda ts: [[len(t)] for t in ts], 1, store))
    whole = embed()
    (file,) = glob.glob(f"{store.path}/prefix=a/*.parquet")
    with open(file, "r+b") as fh:
        raw = fh.read()
        fh.seek(0)
        fh.write(b"\0" * len(raw))
    rows = spark.createDataFrame([("a1", [1.0]), ("b1", [2.0])], "cache_key string, vec array<float>")
    for step in (embed, lambda: store.put(rows), lambda: store.table().collect()):
        with pytest.raises(Exception, match="FAILED_READ_FILE"):
            step()
    assert [f.rsplit("/", 1)[1] for f in store.repair(rows)] == [file.rsplit("/", 1)[1]]
    assert store.unreadable() == [] and batch_rows(store.table()) == [("a1", [1.0]), ("b1", [2.0])] and embed() == whole
    (aside,) = glob.glob(f"{store.path}/prefix=a/_unreadable-*")
    assert len(open(aside, "rb").read()) == len(raw)


def test_strict_json(spark):
    import pytest
    from plumbline.sources import files

    path = shared_dir(spark, "strict")
    spark.createDataFrame([('{"pair_id":"a","similarity":0.5}',), ("",), ('{"pair_id": 12 oops',)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        files.read_pairs(spark, path).collect()
    assert files.read_pairs(spark, path + "-absent").count() == 0


def test_wrong_embedding_size_stops(spark):
    import pytest
    from plumbline.sources.files import embed_all

    texts = spark.createDataFrame([("a", "h", "x")], "key string, text_hash string, text string")
    with pytest.raises(Exception, match="one vector of 3 numbers"):
        embed_all(texts, lambda ts: [[1.0, 2.0] for _ in ts], 3).collect()


def test_keys_of_turn_rows_equal_those_of_arrays(spark):
    """Escapes, a conversation longer than a batch, one without spoken turns, one without turns, repeated turn numbers."""
    said = [(1, 0, " System", 'say "x"\n\t\u00e9\u2028 \\ \x01'), (1, 1, "user", "a  b"), (1, 2, "assistant", "\U0001f600 c"), (2, 5, "system", "only rules"),
            (3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (None, 0, "user", "no conversation"), (9, 0, "user", "no request")]
    said += [(4, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 3)) for i in range(25000)]
    turns = spark.createDataFrame(said, "conv_id bigint, turn int, role string, text string").repartition(7)
    params = F.create_map(F.lit("b"), F.lit('"q"'), F.lit("a"), F.lit("1"))
    requests = spark.createDataFrame([(i, f"m{i}", "v'1") for i in (1, 2, 3, 4, 5)], "conv_id bigint, model string, prompt_version string").withColumn("params", params)
    got = {r["conv_id"]: r.asDict() for r in traces.turn_request_keys(turns, requests).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[4]["turns"] == 25000 and got[5]["turns"] == 0
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    arrays = requests.join(turns.groupBy("conv_id").agg(messages.alias("messages")), "conv_id", "left")
    arrays = arrays.withColumn("messages", F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")))
    for r in traces.request_keys(arrays.withColumnRenamed("conv_id", "request_id")).collect():
        want = r.asDict()
        assert {k: got[want["request_id"]][k] for k in want if k != "request_id"} == {k: v for k, v in want.items() if k != "request_id"}


def test_odd_turn_rows(spark):
    schema = "conv_id string, turn bigint, role string, text string"
    requests = spark.createDataFrame([("a", "m", "v")], "conv_id string, model string, prompt_version string").withColumn("params", F.create_map(F.lit("a"), F.lit("1")))
    keys = lambda rows: [r["exact_key"] for r in traces.turn_request_keys(spark.createDataFrame(rows, schema), requests).collect()]
    assert keys([("a", None, None, None), ("a", 0, "user", "x")]) == keys([("a", -1, "", ""), ("a", 0, "user", "x")])
    assert len(keys([])) == 1
    with pytest.raises(Exception, match="listed twice"):
        traces.turn_request_keys(spark.createDataFrame([("a", 0, "user", "x")], schema), requests.unionAll(requests)).collect()
    assert traces.turn_request_keys(spark.createDataFrame([], schema), requests.limit(0)).collect() == []
