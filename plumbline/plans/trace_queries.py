"""Traces: assembly from event logs, spend, latency, health, identity, request rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import rules, traces
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.registry import registered

_TRACE = """SELECT a.*, a.input_tokens*c.input_nano+a.output_tokens*c.output_nano AS cost_nano FROM assembled a LEFT JOIN catalog c USING (model)"""
_TRACE_COLUMNS = ["request_id", "model", "input_tokens", "output_tokens", "text", "thinking_chars", "events", "created_at", "latency_ms", "ttft_ms",
                  "usage_is_final", "finish_reason", "error_kind", "cost_nano"]


@registered("assemble_traces", o.query(f"SELECT {', '.join(_TRACE_COLUMNS)} FROM ({_TRACE})", "assembled", "catalog"))
def assemble_traces(spark, d):
    return traces.assemble_traces(fx.event_log(spark, d), fx.catalog(spark)).select(*_TRACE_COLUMNS)


@registered("confirmed_usage", o.query("SELECT id, cost_nano FROM traces WHERE usage_is_final", "traces"))
def confirmed_usage(spark, d):
    return traces.confirmed_usage(fx.traces(spark, d)).select("id", "cost_nano")


@registered("error_traces", o.query("SELECT id, status, error_kind FROM traces WHERE status>=400", "traces"))
def error_traces(spark, d):
    return traces.errors(fx.traces(spark, d)).select("id", "status", "error_kind")


@registered("payload_contains", o.query("SELECT id FROM traces WHERE response_body::JSON->>'$.text'='r42'", "traces"))
def payload_contains(spark, d):
    return traces.payload_contains(fx.traces(spark, d), "response_body", "$.text", "r42").select("id")


@registered("by_request_id", o.query("SELECT id, request_id FROM traces WHERE request_id='req-128'", "traces"))
def by_request_id(spark, d):
    return traces.by_request_id(fx.traces(spark, d), "req-128").select("id", "request_id")


@registered("last_traces", o.query("SELECT id, created_at FROM traces ORDER BY created_at DESC, id DESC LIMIT 60", "traces"))
def last_traces(spark, d):
    return traces.last_n(fx.traces(spark, d)).select("id", "created_at")


_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_served ORDER BY created_at DESC, id DESC)::INT AS rn FROM traces) WHERE rn<=20"
_SHOWN = """SELECT *, left(coalesce(request_body::JSON->'$.messages[#-1]'->>'content',''),400) AS prompt_preview,
  left(coalesce(response_body::JSON->>'$.text', response_body::JSON->>'$.choices[0].message.content',''),1200) AS response_text, (SELECT count(*) FROM traces) AS total_traces FROM top"""


@registered("top_n_per_model", o.query("SELECT model_served, id, rn FROM top", "traces", top=_TOP))
def top_n_per_model(spark, d):
    return traces.top_n_per_model(fx.traces(spark, d), 20).select("model_served", "id", "rn")


@registered("trace_previews", o.query(
    "SELECT id, prompt_preview, response_text FROM shown", "traces", top="SELECT * FROM traces", shown=_SHOWN))
def trace_previews(spark, d):
    return traces.with_previews(fx.traces(spark, d)).select("id", "prompt_preview", "response_text")


@registered("export_trace_sample", o.query("SELECT id, model_served, created_at, prompt_preview, response_text, total_traces FROM shown", "traces", top=_TOP, shown=_SHOWN))
def export_trace_sample(spark, d):
    return traces.export_trace_sample(fx.traces(spark, d), 20).select("id", "model_served", "created_at", "prompt_preview", "response_text", "total_traces")


@registered("sample_overview", o.query(
    """SELECT count(*) AS sampled, max(total_traces) AS total_traces, count(*) FILTER (response_text<>'') AS replayable, count(*) FILTER (status>=400) AS errors,
       count(DISTINCT model_served) AS models FROM shown""", "traces", top=_TOP, shown=_SHOWN))
def sample_overview(spark, d):
    return traces.sample_overview(traces.export_trace_sample(fx.traces(spark, d), 20))


@registered("distinct_models", o.query("SELECT DISTINCT model_served FROM traces", "traces"))
def distinct_models(spark, d):
    return traces.distinct_models(fx.traces(spark, d))


@registered("trace_provenance", o.query(
    """SELECT i.slug, t.id AS source_trace_id, t.route_key, t.model_served, r.assigned_model FROM (SELECT slug, key AS tid FROM items) i LEFT JOIN traces t ON t.id=i.tid
       LEFT JOIN (SELECT event_type AS route_key, max(CASE WHEN event_id%2=0 THEN 'm-mid' ELSE 'm-large' END) AS assigned_model FROM events WHERE event_type<>'view' GROUP BY 1) r ON r.route_key=t.route_key""", "items", "traces"))
def trace_provenance(spark, d):
    policy = fx.load(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("route_key")).agg(
        F.max(F.when(F.col("event_id") % 2 == 0, "m-mid").otherwise("m-large")).alias("assigned_model")).withColumn("policy_version", F.lit(1))
    served = fx.traces(spark, d)
    items = fx.items(spark, d).select("slug", F.col("key").alias("source_trace_id"))
    joined = traces.trace_provenance(items, served, policy)
    known = F.col("model_served").isNotNull()
    return joined.select("slug", F.when(known, F.col("source_trace_id")).alias("source_trace_id"), "route_key", "model_served", "assigned_model")


_HOURLY = "SELECT date_trunc('hour',created_at) AS hour, model_served, count(*) AS requests, coalesce(sum(cost_nano),0)::BIGINT AS cost_nano, count(*) FILTER (cost_nano IS NULL) AS unpriced FROM traces GROUP BY ALL"


@registered("spend_by_hour", o.query("SELECT * FROM hourly", "traces", hourly=_HOURLY))
def spend_by_hour(spark, d):
    return traces.spend_by_hour(fx.traces(spark, d))


@registered("peak_hour", o.query("SELECT hour, sum(cost_nano)::BIGINT AS cost_nano, sum(unpriced)::BIGINT AS unpriced FROM hourly GROUP BY hour ORDER BY 2 DESC, 1 LIMIT 1", "traces", hourly=_HOURLY))
def peak_hour(spark, d):
    return traces.peak_hour(traces.spend_by_hour(fx.traces(spark, d)))


_BYMODEL = "SELECT model_served, count(*) AS requests, sum(cost_nano)::BIGINT AS cost_nano, count(*) FILTER (cost_nano IS NULL) AS unpriced, sum(cost_nano)/(SELECT sum(cost_nano) FROM traces)::DOUBLE AS share, sum(cost_nano)/count(cost_nano)::DOUBLE AS mean_nano FROM traces GROUP BY model_served"

#: Every 97th trace was served by a model the catalogue does not price.
_SOME_UNPRICED = "SELECT * REPLACE (CASE WHEN id%97<>0 THEN cost_nano END AS cost_nano) FROM traces"


def some_unpriced(rows):
    return rows.withColumn("cost_nano", F.when(F.col("id") % 97 != 0, F.col("cost_nano")))


@registered("spend_by_hour_unpriced", o.query("SELECT * FROM hourly", "traces", partly=_SOME_UNPRICED, hourly=_HOURLY.replace("FROM traces", "FROM partly")))
def spend_by_hour_unpriced(spark, d):
    return traces.spend_by_hour(some_unpriced(fx.traces(spark, d)))


@registered("spend_ranking_unpriced", o.query(_BYMODEL.replace("FROM traces", "FROM partly"), "traces", partly=_SOME_UNPRICED))
def spend_ranking_unpriced(spark, d):
    return traces.spend_ranking(some_unpriced(fx.traces(spark, d)))


@registered("spend_ranking", o.query(f"{_BYMODEL} ORDER BY cost_nano DESC", "traces"))
def spend_ranking(spark, d):
    return traces.spend_ranking(fx.traces(spark, d))


@registered("pass_rate_ranking", o.query(
    "SELECT model, count(*) AS n, count(*) FILTER (passed) AS passes, count(*) FILTER (passed)/count(*)::DOUBLE AS pass_rate FROM pilot GROUP BY model ORDER BY pass_rate DESC", "pilot"))
def pass_rate_ranking(spark, d):
    from plumbline.operators import corpus
    return traces.pass_rate_ranking(corpus.pass_rates(fx.pilot(spark, d))).drop("task_type")


@registered("route_rollup", o.query(
    "SELECT route_key, date_trunc('day',created_at)::TIMESTAMP AS window_start, count(*) AS requests, sum(cost_nano)::BIGINT AS cost_nano, count(*) FILTER (cost_nano IS NULL) AS unpriced FROM traces GROUP BY ALL", "traces"))
def route_rollup(spark, d):
    return traces.route_rollup(fx.traces(spark, d))


@registered("duplicate_requests", o.query(
    "SELECT request_hash, count(*) AS requests, min(created_at) AS first_at, max(created_at) AS last_at, sum(cost_nano)::BIGINT AS cost_nano, count(*) FILTER (cost_nano IS NULL) AS unpriced FROM traces GROUP BY request_hash HAVING count(*)>1", "traces"))
def duplicate_requests(spark, d):
    return traces.duplicate_requests(fx.traces(spark, d))


_PROFILE = """SELECT model_served, count(*) AS requests, sum(latency_ms)/count(*)::DOUBLE AS mean, max(latency_ms) AS max,
  count(*)/((epoch_us(max(created_at))//1000-epoch_us(min(created_at))//1000)/1000.0::DOUBLE) AS rps, sum(bytes)::BIGINT AS bytes, round(sum(bytes)/count(*)::DOUBLE)::BIGINT AS bytes_per_request,
  count(*) FILTER (status<200 OR status>=300) AS non_2xx, count(error_kind) AS errors, quantile_cont(latency_ms,0.5)::DOUBLE AS p50, quantile_cont(latency_ms,0.9)::DOUBLE AS p90,
  quantile_cont(latency_ms,0.975)::DOUBLE AS p95, quantile_cont(latency_ms,0.99)::DOUBLE AS p99 FROM traces GROUP BY model_served"""


@registered("latency_profile", o.query(
    """SELECT model_served, requests, mean, max, rps, bytes, bytes_per_request, non_2xx, errors, round(p50,6) AS p50, round(p90,6) AS p90, round(p95,6) AS p95, round(p99,6) AS p99 FROM prof""", "traces", prof=_PROFILE))
def latency_profile(spark, d):
    profile = traces.latency_profile(fx.traces(spark, d))
    return profile.select(*[F.round(c, 6).alias(c) if c in traces.LATENCY_PERCENTILES else F.col(c) for c in profile.columns])


@registered("arm_overhead", o.query(
    """SELECT """ + ", ".join(f"round(b.{c}-a.{c},3) AS overhead_{c}" for c in ("p50", "p90", "p95", "p99", "mean")) +
    """, round(b.bytes_per_request/greatest(a.bytes_per_request,1)::DOUBLE,2) AS bytes_ratio, round(b.rps*60)::BIGINT AS requests_per_minute
       FROM prof a, prof b WHERE a.model_served='m-small' AND b.model_served='m-mid'""", "traces", prof=_PROFILE))
def arm_overhead(spark, d):
    return traces.arm_overhead(traces.latency_profile(fx.traces(spark, d)), fx.CHEAP, fx.MID)


_RUNS = """SELECT *, sum((NOT counts)::INT) OVER (PARTITION BY provider ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM traces WHERE counts IS NOT NULL"""
_INCIDENTS = """SELECT provider, count(*) AS failures, min(created_at) AS first_failure_at, max(created_at) FILTER (rn=5) AS opened_at, max(created_at) AS last_failure_at FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, run ORDER BY created_at, id) AS rn FROM runs WHERE counts) GROUP BY provider, run HAVING count(*)>=5"""


@registered("failure_runs", o.query("SELECT * FROM incidents", "traces", runs=_RUNS, incidents=_INCIDENTS))
def failure_runs(spark, d):
    return traces.failure_runs(fx.traces(spark, d))


WS_SQL = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _canon(content: str) -> str:
    return f"regexp_replace(regexp_replace({content},'{WS_SQL}+',' ','g'),'^{WS_SQL}+|{WS_SQL}+$','','g')"


_SYSTEM = "  Be brief.\n\tAnswer in  the same language. "


@registered("request_keys", o.query(
    """SELECT doc_id AS request_id, length(canonical) AS canonical_chars, sha256(canonical) AS canonical_sha,
       sha256('{"messages":'||to_json(canonical)||',"model":"m-mid","promptVersion":"v1","params":{"max_tokens":256,"temperature":'||(doc_id%3)||'}}') AS exact_key,
       sha256('m-mid'||chr(0)||'user:'||body) AS embedding_hash, length(text) AS user_prompt_chars, greatest(1,(length(sys)+2+length(text))//4) AS token_estimate,
       greatest(1,(length(sys)+2+length(text))//3) AS worst_case_tokens FROM keyed""",
    keyed=f"SELECT doc_id, text, sys, body, 'system:'||{_canon('sys')}||chr(10)||'user:'||body AS canonical FROM (SELECT doc_id, text, {_canon('text')} AS body, '{_SYSTEM.replace(chr(10), chr(39) + '||chr(10)||' + chr(39)).replace(chr(9), chr(39) + '||chr(9)||' + chr(39))}' AS sys FROM documents)"))
def request_keys(spark, d):
    """Keys and sizes of one request per document, over the whole text."""
    messages = F.array(F.struct(F.lit(" System").alias("role"), F.lit(_SYSTEM).alias("content")),
                       F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    params = F.create_map(F.lit("temperature"), (F.col("doc_id") % 3).cast("string"), F.lit("max_tokens"), F.lit("256"))
    return traces.request_keys(fx.load(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), messages.alias("messages"), F.lit(fx.MID).alias("model"), F.lit("v1").alias("prompt_version"), params.alias("params")))


def _tree(level: str, frm: str, last: bool = False) -> str:
    return f"SELECT conv_id, pos//1024 AS pos, sha256(string_agg(h,'' ORDER BY pos)) AS h, sum(chars) AS chars, sum(raw) AS raw, sum(turns) AS turns FROM {frm} GROUP BY conv_id, pos//1024"


@registered("conversation_keys", o.query(
    "SELECT conv_id, turns::BIGINT AS turns, (chars+turns-1)::BIGINT AS canonical_chars, greatest(1,(raw+2*(turns-1))//4)::BIGINT AS token_estimate, h AS conversation_key FROM t3",
    t0=f"SELECT conv_id, turn AS pos, sha256(line) AS h, length(line) AS chars, length(text) AS raw, 1 AS turns FROM (SELECT *, lower(role)||':'||{_canon('text')} AS line FROM conversations)",
    t1=_tree("t1", "t0"), t2=_tree("t2", "t1"), t3=_tree("t3", "t2")))
def conversation_keys(spark, d):
    return traces.conversation_keys(fx.load(spark, d, "conversations"))


@registered("request_bodies", o.query(
    """SELECT doc_id AS request_id, length('be brief'||chr(10)||chr(10)||text) AS prompt_chars, sha256('be brief'||chr(10)||chr(10)||text) AS prompt_sha,
       sha256('{"model":"m-mid","messages":[{"role":"user","content":'||to_json(text)||'}]}') AS body_hash,
       sha256('{"messages":[{"role":"user","content":'||to_json(text)||'}],"model":"m-mid"}') AS reordered_hash FROM documents"""))
def request_bodies(spark, d):
    """Joined prompts and hashes of raw bodies of all documents; a body with its keys in another order is another body."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = text.prompt_text(F.array(message("system", F.lit("be brief")), message("user", F.col("text"))))
    said = F.concat(F.lit('"messages":[{"role":"user","content":'), text.json_string(F.col("text")), F.lit("}]"))
    return fx.load(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), F.length(prompt).alias("prompt_chars"), F.sha2(prompt, 256).alias("prompt_sha"),
        text.request_hash(F.concat(F.lit('{"model":"m-mid",'), said, F.lit("}"))).alias("body_hash"),
        text.request_hash(F.concat(F.lit("{"), said, F.lit(',"model":"m-mid"}'))).alias("reordered_hash"))


@registered("turn_request_keys", o.query(
    """SELECT conv_id, count(*) AS turns, length(string_agg(line,chr(10) ORDER BY turn)) AS canonical_chars, sha256(string_agg(line,chr(10) ORDER BY turn)) AS canonical_sha,
       sha256('{"messages":'||to_json(string_agg(line,chr(10) ORDER BY turn))||',"model":"'||model||'","promptVersion":"v'||(conv_id%2)||'","params":{"max_tokens":256,"temperature":'||(conv_id%3)||'}}') AS exact_key,
       sha256(model||chr(0)||coalesce(string_agg(line,chr(10) ORDER BY turn) FILTER (spoken), string_agg(line,chr(10) ORDER BY turn))) AS embedding_hash,
       coalesce(sum(raw+2) FILTER (spoken), sum(raw+2))::BIGINT-2 AS user_prompt_chars, greatest(1,(sum(raw+2)-2)//4)::BIGINT AS token_estimate, greatest(1,(sum(raw+2)-2)//3)::BIGINT AS worst_case_tokens
       FROM said GROUP BY conv_id, model""",
    said=f"SELECT conv_id, turn, {o.model('conv_id')} AS model, lower(role)||':'||{_canon('text')} AS line, length(text) AS raw, role IN ('user','assistant') AS spoken FROM conversations"))
def turn_request_keys(spark, d):
    """Exact keys, embedding hashes and sizes of all conversations, from one row per turn."""
    turns = fx.load(spark, d, "conversations")
    key = F.col("conv_id")
    params = F.create_map(F.lit("temperature"), (key % 3).cast("string"), F.lit("max_tokens"), F.lit("256"))
    requests = turns.select("conv_id").distinct().select(
        key, fx.model_of(key).alias("model"), F.concat(F.lit("v"), key % 2).alias("prompt_version"), params.alias("params"))
    return traces.turn_request_keys(turns, requests)


@registered("cache_keys", o.query(
    """SELECT doc_id, model, sha256('{"messages":[{"content":'||to_json(text)||',"role":"user"}],"model":"'||model||'","params":{"max_tokens":'||least(40000,max_output_tokens)||
       CASE WHEN supports_sampling_params THEN ',"temperature":0.0' ELSE '' END||'},"replicate_idx":'||(doc_id%3)||'}') AS cache_key FROM documents, catalog""", "catalog"))
def cache_keys(spark, d):
    """Content address of every (document, model) call."""
    from plumbline.operators.costing import build_tasks
    tasks = build_tasks(fx.load(spark, d, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("slug")), fx.LADDER)
    joined = tasks.join(fx.catalog(spark), "model")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    params = text.request_params(F.lit(40000), F.col("max_output_tokens"), F.col("supports_sampling_params"))
    return joined.select("doc_id", "model", text.cache_key(F.col("model"), messages, params, F.col("doc_id") % 3).alias("cache_key"))


@registered("validate_requests", o.query(
    """SELECT request_id, array_to_string(list_filter([CASE WHEN role='system' THEN 'non_system_message' END, CASE WHEN n IS NOT NULL AND n<>1 THEN 'n' END,
       CASE WHEN temperature IS NOT NULL AND NOT temperature BETWEEN 0 AND 2 THEN 'temperature' END, CASE WHEN top_p IS NOT NULL AND NOT (top_p>0 AND top_p<=1) THEN 'top_p' END,
       CASE WHEN stops IS NOT NULL AND stops>4 THEN 'stop' END, CASE WHEN max_tokens IS NOT NULL AND max_tokens<=0 THEN 'max_tokens' END,
       CASE WHEN max_completion_tokens IS NOT NULL AND max_completion_tokens<=0 THEN 'max_completion_tokens' END], lambda x: x IS NOT NULL),',') AS failed_rules FROM requests""", "requests"))
def validate_requests(spark, d):
    return rules.validate_requests(fx.requests(spark, d)).select("request_id", F.array_join("failed_rules", ",").alias("failed_rules"))


@registered("parameter_compat", o.query(
    """SELECT request_id, CASE WHEN bad AND pinned THEN given[1] END AS rejected_param, CASE WHEN bad AND NOT pinned THEN array_to_string(given,',') ELSE '' END AS dropped_params,
       least(coalesce(max_completion_tokens,max_tokens,4096),max_output_tokens) AS output_cap FROM (
       SELECT *, NOT supports_sampling_params AND len(given)>0 AS bad FROM (SELECT r.*, c.max_output_tokens, c.supports_sampling_params,
         list_filter([CASE WHEN temperature IS NOT NULL THEN 'temperature' END, CASE WHEN top_p IS NOT NULL THEN 'top_p' END], lambda x: x IS NOT NULL) AS given FROM requests r JOIN catalog c ON c.model=r.target))""", "requests", "catalog"))
def parameter_compat(spark, d):
    targeted = fx.requests(spark, d).drop("model").withColumnRenamed("target", "model")
    return rules.parameter_compat(targeted, fx.catalog(spark), 4096).select(
        "request_id", "rejected_param", F.array_join("dropped_params", ",").alias("dropped_params"), "output_cap")


_FILES = """SELECT page_id//3 AS pr, CASE page_id%5 WHEN 0 THEN 'prompts/README.md' WHEN 1 THEN 'src/'||page_id||'.py' WHEN 2 THEN 'prompts/judge.md' WHEN 3 THEN regexp_replace(url,'^http://','') ELSE 'prompts/a/CHANGELOG.md' END AS filename FROM pages"""


@registered("touches_prompts", o.query(
    """SELECT pr, count(*) AS files, bool_or(starts_with(filename,'prompts/') AND lower(list_last(string_split(filename,'/'))) NOT IN ('readme.md','contributing.md','changelog.md','.gitkeep')) AS touches_prompts FROM files GROUP BY pr""", files=_FILES))
def touches_prompts(spark, d):
    i = F.col("page_id")
    name = (F.when(i % 5 == 0, "prompts/README.md").when(i % 5 == 1, F.concat(F.lit("src/"), i, F.lit(".py"))).when(i % 5 == 2, "prompts/judge.md")
            .when(i % 5 == 3, F.regexp_replace("url", "^http://", "")).otherwise("prompts/a/CHANGELOG.md"))
    return rules.touches_prompts(fx.load(spark, d, "pages").select(F.floor(i / 3).alias("pr"), name.alias("filename")))
