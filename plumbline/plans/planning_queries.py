"""Runs before and after: tasks, cache matches, projections, summaries, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import answers, money, serving, text
from plumbline.operators import costing, pairing, rules
from plumbline.operators.ranking import join_shuffled
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.registry import registered
from plumbline.sources.catalog import price_catalog

_REPS = "SELECT slug, CASE WHEN row_number() OVER (ORDER BY slug)<=100 THEN 3 ELSE 1 END AS replicates FROM (SELECT DISTINCT slug FROM items)"


@registered("replicate_map", o.query("SELECT slug, replicates FROM reps", "items", reps=_REPS))
def replicate_map(spark, d):
    return costing.replicate_map(fx.items(spark, d), 100, 3)


_TASKS = "SELECT slug, task_type, l.model, l.rung AS model_pos, unnest(range(0,replicates)) AS replicate_idx FROM items JOIN reps USING (slug), ladder l"


def _tasks(spark, d):
    items = fx.items(spark, d)
    return costing.build_tasks(items.select("slug", "task_type"), fx.LADDER, costing.replicate_map(items, 100, 3))


@registered("build_tasks", o.query("SELECT slug, task_type, model, model_pos, replicate_idx FROM tasks", "items", "ladder", reps=_REPS, tasks=_TASKS))
def build_tasks(spark, d):
    return costing.in_task_order(_tasks(spark, d))


_STORE = "SELECT DISTINCT slug||'#'||model||'#'||replicate_idx AS cache_key FROM generations"


def _keyed(df):
    return df.withColumn("cache_key", F.concat_ws("#", "slug", "model", "replicate_idx"))


@registered("pending_tasks", o.query(
    "SELECT model, count(*) AS pending FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM store) GROUP BY model",
    "items", "ladder", "generations", reps=_REPS, tasks=_TASKS, keyed="SELECT *, slug||'#'||model||'#'||replicate_idx AS cache_key FROM tasks", store=_STORE))
def pending_tasks(spark, d):
    pending = costing.pending_tasks(_keyed(_tasks(spark, d)), _keyed(fx.generations(spark, d)))
    return pending.groupBy("model").agg(F.count(F.lit(1)).alias("pending"))


@registered("cached_tasks", o.query(
    "SELECT model, count(*) AS cached FROM keyed WHERE cache_key IN (SELECT cache_key FROM store) GROUP BY model",
    "items", "ladder", "generations", reps=_REPS, tasks=_TASKS, keyed="SELECT *, slug||'#'||model||'#'||replicate_idx AS cache_key FROM tasks", store=_STORE))
def cached_tasks(spark, d):
    cached = costing.cached_tasks(_keyed(_tasks(spark, d)), _keyed(fx.generations(spark, d)))
    return cached.groupBy("model").agg(F.count(F.lit(1)).alias("cached"))


@registered("cache_stats", o.query(
    "SELECT model, count(*) FILTER (from_cache) AS hits, count(*) FILTER (NOT from_cache) AS misses, count(*) FILTER (from_cache)/count(*)::DOUBLE AS hit_rate FROM outcomes GROUP BY model", "outcomes"))
def cache_stats(spark, d):
    return costing.cache_stats(fx.outcomes(spark, d), F.col("from_cache"), ["model"])


_OUT = "least(CASE task_type WHEN 'math_word_problem' THEN 650 WHEN 'multiple_choice' THEN 650 WHEN 'summarization' THEN 220 WHEN 'long_form_qa' THEN 420 WHEN 'support_reply' THEN 260 ELSE 300 END, max_output_tokens)"
_PROJ = f"""SELECT model, sum(replicates)::BIGINT AS calls, sum(replicates*greatest(1,prompt_chars//4))::BIGINT AS input_tokens, sum(replicates*{_OUT})::BIGINT AS output_tokens,
  (sum(replicates*greatest(1,prompt_chars//4))*any_value(input_nano)+sum(replicates*{_OUT})*any_value(output_nano))::BIGINT AS cost_nano
  FROM items JOIN reps USING (slug), catalog GROUP BY model"""


def _projection(spark, d):
    items = fx.items(spark, d)
    sized = join_shuffled(items, costing.replicate_map(items, 100, 3), "slug")
    return costing.project_cost(sized, fx.catalog(spark))


@registered("project_cost", o.query("SELECT * FROM proj", "items", "catalog", reps=_REPS, proj=_PROJ))
def project_cost(spark, d):
    return _projection(spark, d)


_SUMMARY = """SELECT model, count(*) AS calls_attempted, count(*) FILTER (error_kind IS NULL) AS calls_succeeded, count(*) FILTER (error_kind IS NOT NULL) AS calls_failed,
  count(*) FILTER (from_cache) AS cache_hits, sum(CASE WHEN error_kind IS NULL THEN input_tokens ELSE 0 END)::BIGINT AS input_tokens,
  sum(CASE WHEN error_kind IS NULL THEN output_tokens ELSE 0 END)::BIGINT AS output_tokens, coalesce(sum(CASE WHEN from_cache THEN 0 ELSE cost_nano END),0)::BIGINT AS cost_nano, count(*) FILTER (NOT from_cache AND cost_nano IS NULL) AS unpriced,
  count(*) FILTER (error_kind IS NULL AND NOT usage_is_final) AS unconfirmed_usage_calls,
  count(*) FILTER (error_kind IS NULL AND passed IS NOT NULL) AS graded_n,
  floor(quantile_cont(latency_ms,0.5) FILTER (error_kind IS NULL AND NOT from_cache AND latency_ms>0))::BIGINT AS median_latency_ms,
  count(*) FILTER (error_kind IS NULL AND passed)/nullif(count(*) FILTER (error_kind IS NULL AND passed IS NOT NULL),0)::DOUBLE AS pass_rate
  FROM outcomes GROUP BY model"""


@registered("run_summary", o.query("SELECT * FROM summary", "outcomes", summary=_SUMMARY))
def run_summary(spark, d):
    return costing.run_summary(fx.outcomes(spark, d))


#: Samples of one input size in thirteen were served at a price nobody has verified.
_SOME_UNPRICED = "SELECT * REPLACE (CASE WHEN input_tokens%13<>0 THEN cost_nano END AS cost_nano) FROM outcomes"


@registered("run_summary_unpriced", o.query("SELECT * FROM summary", "outcomes", partly=_SOME_UNPRICED, summary=_SUMMARY.replace("FROM outcomes", "FROM partly")))
def run_summary_unpriced(spark, d):
    return costing.run_summary(fx.outcomes(spark, d).withColumn("cost_nano", F.when(F.col("input_tokens") % 13 != 0, F.col("cost_nano"))))


@registered("projected_vs_actual", o.query(
    """SELECT model, p.cost_nano AS projected_nano, s.cost_nano AS actual_nano, CASE WHEN p.cost_nano=0 THEN 0.0 ELSE s.cost_nano/p.cost_nano::DOUBLE END AS actual_over_projected,
       p.cost_nano<=20000000000 AS within_cap FROM proj p JOIN summary s USING (model)""",
    "items", "catalog", "outcomes", reps=_REPS, proj=_PROJ, summary=_SUMMARY))
def projected_vs_actual(spark, d):
    return costing.projected_vs_actual(_projection(spark, d), costing.run_summary(fx.outcomes(spark, d)), 20_000_000_000)


@registered("errors_by_kind", o.query("SELECT error_kind, count(*) AS errors FROM outcomes WHERE error_kind IS NOT NULL GROUP BY error_kind", "outcomes"))
def errors_by_kind(spark, d):
    return costing.errors_by_kind(fx.outcomes(spark, d))


@registered("median_output_tokens", o.query(
    "SELECT task_type, floor(quantile_cont(output_tokens,0.5))::BIGINT AS median_output_tokens FROM outcomes GROUP BY task_type", "outcomes"))
def median_output_tokens(spark, d):
    return costing.median_output_tokens(fx.outcomes(spark, d))


_RUNNING = """SELECT id, created_at, created_at::DATE AS day, cost_nano, sum(cost_nano) OVER (PARTITION BY created_at::DATE ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent_nano FROM traces"""


@registered("cumulative_spend", o.query(
    "SELECT id, day, spent_nano, greatest(0,80000000-spent_nano)::BIGINT AS remaining_nano, spent_nano>80000000 AS over_cap FROM running", "traces", running=_RUNNING))
def cumulative_spend(spark, d):
    traces = fx.traces(spark, d).withColumn("day", F.to_date("created_at"))
    return costing.cumulative_spend(traces, 80_000_000, ["day"]).select("id", "day", "spent_nano", "remaining_nano", "over_cap")


@registered("cumulative_spend_unpriced", o.query(
    "SELECT id, day, coalesce(spent_nano,0) AS spent_nano, coalesce(spent_nano,0)>80000000 AS over_cap, cost_nano IS NULL AS unpriced FROM running", "traces",
    partly="SELECT * REPLACE (CASE WHEN id%97<>0 THEN cost_nano END AS cost_nano) FROM traces", running=_RUNNING.replace("FROM traces", "FROM partly")))
def cumulative_spend_unpriced(spark, d):
    rows = fx.traces(spark, d).withColumn("day", F.to_date("created_at")).withColumn("cost_nano", F.when(F.col("id") % 97 != 0, F.col("cost_nano")))
    return costing.cumulative_spend(rows, 80_000_000, ["day"]).select("id", "day", "spent_nano", "over_cap", "unpriced")


@registered("first_over_cap", o.query(
    "SELECT day, arg_min(id, spent_nano) AS id, min(spent_nano)::BIGINT AS spent_nano FROM running WHERE spent_nano>80000000 GROUP BY day", "traces", running=_RUNNING))
def first_over_cap(spark, d):
    traces = fx.traces(spark, d).withColumn("day", F.to_date("created_at"))
    return costing.first_over_cap(traces, 80_000_000, ["day"]).select("day", "id", "spent_nano")


_MASK = """SELECT g.slug, g.model, (CASE WHEN bool_or(g.replicate_idx=0) THEN min(g.replicate_idx) FILTER (n.replicate_idx IS NULL)+1 ELSE 0 END)::INT AS samples
  FROM (SELECT DISTINCT slug, model, replicate_idx FROM generations WHERE replicate_idx>=0) g
  LEFT JOIN (SELECT DISTINCT slug, model, replicate_idx FROM generations) n ON n.slug=g.slug AND n.model=g.model AND n.replicate_idx=g.replicate_idx+1 GROUP BY g.slug, g.model"""


@registered("contiguous_replicates", o.query("SELECT slug, model, samples FROM used", "generations", used=_MASK))
def contiguous_replicates(spark, d):
    return costing.contiguous_replicates(fx.generations(spark, d))


NUMBER_SQL = """try_cast(replace(coalesce(list_last(regexp_extract_all(regexp_replace({t},
  '(?is)^.*(?:####|final answer\\s*(?:is)?\\s*:?|answer\\s*(?:is)?\\s*:?|\\\\boxed\\{{)',''), '-?\\d[\\d,]*(?:\\.\\d+)?')),
  list_last(regexp_extract_all({t}, '-?\\d[\\d,]*(?:\\.\\d+)?'))), ',', '') AS DOUBLE)"""
CHOICE_SQL = """upper(coalesce(list_last(regexp_extract_all({t}, '(?i)(?:answer\\s*(?:is)?\\s*:?|option\\s*:?|\\\\boxed\\{{|####)\\s*\\(?([A-J])\\)?\\b', 1)),
  list_last(regexp_extract_all({t}, '\\b\\(?([A-J])\\)?\\b', 1))))"""
_ANSWERS = f"""SELECT g.slug, g.model, g.replicate_idx, i.verifier, CASE i.verifier WHEN 'final_number' THEN {NUMBER_SQL.format(t='g.text')}::VARCHAR
  WHEN 'choice_letter' THEN {CHOICE_SQL.format(t='g.text')} END AS answer, i.ground_truth, i.task_type FROM (SELECT DISTINCT * FROM generations) g JOIN items i USING (slug)"""
_AGREE = """SELECT slug, model, max(c)/sum(c)::DOUBLE AS agreement FROM (SELECT a.slug, a.model, coalesce(answer,'__unparsed_'||replicate_idx) AS ans, count(*) AS c
  FROM answers a JOIN used u ON a.slug=u.slug AND a.model=u.model AND replicate_idx<samples GROUP BY ALL) GROUP BY slug, model"""


@registered("self_consistency", o.query(
    "SELECT u.slug, u.model, samples, CASE WHEN samples>1 THEN agreement END AS agreement FROM used u LEFT JOIN agree USING (slug, model)",
    "generations", "items", used=_MASK, answers=_ANSWERS, agree=_AGREE))
def self_consistency(spark, d):
    gens = fx.generations(spark, d).join(fx.items(spark, d).select("slug", "verifier", "ground_truth"), "slug")
    return costing.samples_per_item(gens).select("slug", "model", "samples", "agreement")


_PASSED = f"""CASE verifier WHEN 'final_number' THEN coalesce(try_cast(answer AS DOUBLE)=ground_truth::DOUBLE,false) WHEN 'choice_letter' THEN coalesce(answer=ground_truth,false) END"""


@registered("grade_generations", o.query(
    f"SELECT task_type, model, replicate_idx, count(*) AS samples, count(*) FILTER ({_PASSED.replace('ground_truth::DOUBLE', 'try_cast(ground_truth AS DOUBLE)')}) AS passes FROM answers GROUP BY ALL",
    "generations", "items", answers=_ANSWERS.replace("(SELECT DISTINCT * FROM generations)", "generations")))
def grade_generations(spark, d):
    graded = pairing.grade_generations(fx.items(spark, d), fx.generations(spark, d))
    return graded.groupBy("task_type", "model", "replicate_idx").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("passed").alias("passes"))


@registered("extract_answers", o.query(
    f"SELECT text, {NUMBER_SQL.format(t='text')} AS number, {CHOICE_SQL.format(t='text')} AS choice, count(*) AS copies FROM generations GROUP BY text", "generations"))
def extract_answers(spark, d):
    texts = fx.generations(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select("text", answers.extract_final_number(F.col("text")).alias("number"),
                        answers.extract_choice(F.col("text")).alias("choice"), "copies")


@registered("document_numbers", o.query(f"SELECT doc_id, {NUMBER_SQL.format(t='text')} AS number FROM documents"))
def document_numbers(spark, d):
    """The final-number rule over whole free texts."""
    return fx.load(spark, d, "documents").select("doc_id", answers.extract_final_number(F.col("text")).alias("number"))


@registered("price_usage", o.query(
    """SELECT id, CASE WHEN err IS NULL THEN input_tokens*input_nano+output_tokens*output_nano+CASE WHEN cr=0 THEN 0 ELSE cr*cache_read_nano END END::BIGINT AS cost_nano, err AS cost_error FROM (
      SELECT *, CASE WHEN input_nano IS NULL THEN 'unknown model' WHEN cr>0 AND cache_read_nano IS NULL THEN 'unverified cache_read price' END AS err FROM (
      SELECT t.id, t.input_tokens, t.output_tokens, CASE WHEN id%6=0 THEN input_tokens//2 ELSE 0 END AS cr, c.* FROM
       (SELECT *, CASE WHEN id%97=0 THEN 'm-unlisted' ELSE model_served END AS m FROM traces) t LEFT JOIN catalog c ON c.model=t.m))""", "traces", "catalog"))
def price_usage(spark, d):
    usage = fx.traces(spark, d).select(
        "id", F.when(F.col("id") % 97 == 0, "m-unlisted").otherwise(F.col("model_served")).alias("model"), "input_tokens", "output_tokens",
        F.when(F.col("id") % 6 == 0, F.floor(F.col("input_tokens") / 2)).otherwise(0).alias("cache_read_tokens"))
    return costing.price_usage(usage, fx.catalog(spark)).select("id", "cost_nano", "cost_error")


_PARTS = """SELECT 'part-'||p_partkey AS model, CASE p_size%3 WHEN 0 THEN 'cheap' WHEN 1 THEN 'mid' ELSE 'strong' END AS rung,
  floor(p_retailprice)/1000 AS input, floor(p_retailprice*5)/1000 AS output, CASE WHEN p_size%2=0 THEN floor(p_retailprice/10)/1000 END AS cache_read FROM part"""
_PRICED = "SELECT model, rung, round_even(input*1000,0)::BIGINT AS input_nano, round_even(output*1000,0)::BIGINT AS output_nano, round_even(cache_read*1000,0)::BIGINT AS cache_read_nano, NULL::BIGINT AS cache_write_nano FROM parts"


def _part_catalog(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    table = fx.load(spark, d, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("model"),
        F.when(size % 3 == 0, "cheap").when(size % 3 == 1, "mid").otherwise("strong").alias("rung"),
        (F.floor(price) / 1000).alias("input"), (F.floor(price * 5) / 1000).alias("output"),
        F.when(size % 2 == 0, F.floor(price / 10) / 1000).alias("cache_read"), F.lit(None).cast("double").alias("cache_write"))
    return price_catalog(table)


@registered("price_catalog", o.query("SELECT * FROM priced", parts=_PARTS, priced=_PRICED))
def catalog_prices(spark, d):
    return _part_catalog(spark, d)


@registered("cheapest_first", o.query(
    "SELECT model, rung, input_nano FROM priced ORDER BY input_nano, model", parts=_PARTS, priced=_PRICED))
def cheapest_first(spark, d):
    return costing.cheapest_first(_part_catalog(spark, d)).select("model", "rung", "input_nano")


@registered("models_at_rung", o.query("SELECT model, input_nano FROM priced WHERE rung='mid'", parts=_PARTS, priced=_PRICED))
def models_at_rung(spark, d):
    return costing.models_at_rung(_part_catalog(spark, d), "mid").select("model", "input_nano")


@registered("money_edges", o.query("SELECT id, cost_nano, round_even(cost_nano/10.0::DOUBLE,0)/1e8::DOUBLE AS cost_usd FROM traces", "traces"))
def money_edges(spark, d):
    return fx.traces(spark, d).select("id", "cost_nano", money.nano_to_usd(F.col("cost_nano")).alias("cost_usd"))


@registered("candidate_models", o.query("SELECT DISTINCT model_served AS model FROM traces WHERE model_served<>'m-large'", "traces"))
def candidate_models(spark, d):
    """The models seen in traffic, less the reference model."""
    return fx.traces(spark, d).select(F.col("model_served").alias("model")).distinct().filter(F.col("model") != fx.STRONG)


@registered("cost_change", o.query(
    """SELECT split, comparison, b AS baseline_nano, c AS candidate_nano, c-b AS cost_delta_nano, CASE WHEN b>0 THEN (c-b)/b::DOUBLE*100 END AS cost_change_pct FROM (
       SELECT x.split, x.model||'->'||y.model AS comparison, x.spent AS b, y.spent AS c FROM spent x JOIN spent y ON x.split=y.split AND x.rung<y.rung)""", "records",
    spent="SELECT split, model, rung, sum(cost_nano)::BIGINT AS spent FROM records GROUP BY ALL"))
def cost_change(spark, d):
    """Every pair of arms, from one sum per arm."""
    arms = fx.records_long(spark, d).groupBy("split").agg(
        *[F.sum(F.when(F.col("model") == m, F.col("cost_nano"))).alias(m) for m in fx.LADDER])
    pairs = [F.struct(F.lit(f"{a}->{b}").alias("comparison"), F.col(a).alias("baseline_nano"), F.col(b).alias("candidate_nano"))
             for i, a in enumerate(fx.LADDER) for b in fx.LADDER[i + 1:]]
    return rules.cost_change(arms.select("split", F.inline(F.array(*pairs))))


@registered("token_estimates", o.query(
    "SELECT doc_id, greatest(1,length(text)//4) AS token_estimate, greatest(1,length(text)//3) AS worst_case_tokens FROM documents"))
def token_estimates(spark, d):
    return fx.load(spark, d, "documents").select(
        "doc_id", text.token_estimate(F.length("text")).alias("token_estimate"), text.worst_case_tokens(F.length("text")).alias("worst_case_tokens"))


@registered("serving_rules", o.query(
    """SELECT id, CASE r WHEN 'max_tokens' THEN 'length' WHEN 'refusal' THEN 'content_filter' WHEN 'tool_use' THEN 'tool_calls' ELSE 'stop' END AS finish_reason,
      CASE WHEN f IS NULL THEN NULL ELSE f IN ('timeout','connection','rate_limited','provider_5xx') END AS retryable,
      CASE WHEN f IS NULL THEN NULL ELSE f NOT IN ('rate_limited','bad_request') END AS counts_toward_breaker,
      CASE f WHEN 'timeout' THEN 504 WHEN 'rate_limited' THEN 429 WHEN 'bad_request' THEN 400 WHEN NULL THEN NULL ELSE CASE WHEN f IS NOT NULL THEN 502 END END AS http_status,
      created_at + to_seconds(CASE route_key WHEN 'click' THEN 60 WHEN 'error' THEN 0 ELSE 3600 END) AS expires_at,
      output_tokens*1000.0::DOUBLE/nullif(latency_ms-ttft_ms,0) AS tokens_per_second, CASE WHEN status>=500 THEN '5xx' WHEN status>=400 THEN '4xx' ELSE 'ok' END AS tone FROM (
      SELECT *, CASE id%5 WHEN 0 THEN 'max_tokens' WHEN 1 THEN 'refusal' WHEN 2 THEN 'tool_use' WHEN 3 THEN 'end_turn' END AS r,
        CASE id%9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'auth' WHEN 4 THEN 'provider_5xx' WHEN 5 THEN 'bad_request' WHEN 6 THEN 'weird' END AS f FROM traces)""", "traces"))
def serving_rules(spark, d):
    i = F.col("id")
    reason = F.when(i % 5 == 0, "max_tokens").when(i % 5 == 1, "refusal").when(i % 5 == 2, "tool_use").when(i % 5 == 3, "end_turn")
    kinds = ["timeout", "connection", "rate_limited", "auth", "provider_5xx", "bad_request", "weird"]
    kind = F.when(i % 9 == 0, kinds[0])
    for n, name in enumerate(kinds[1:], 1):
        kind = kind.when(i % 9 == n, name)
    failure = serving.classify_failure(kind)
    return fx.traces(spark, d).withColumn("_f", failure).select(
        "id", serving.map_finish_reason(reason).alias("finish_reason"), "_f.retryable", "_f.counts_toward_breaker", "_f.http_status",
        serving.ttl_expiry(F.col("created_at"), serving.ttl_seconds(F.col("route_key"), 3600, {"click": 60, "error": 0})).alias("expires_at"),
        serving.stream_rate(F.col("output_tokens"), F.col("latency_ms"), F.col("ttft_ms")).alias("tokens_per_second"),
        serving.status_tone(F.col("status")).alias("tone"))


@registered("custom_verifier", o.query(
    """SELECT task_type, model, count(*) FILTER (verifier IS NOT NULL AND contains(text, ground_truth)) AS passes, count(*) FILTER (verifier IS NULL OR ground_truth IS NULL) AS ungraded,
       count(DISTINCT nullif(regexp_extract(text,'[0-9]+'),'')) AS answers FROM generations g JOIN items i USING (slug) GROUP BY ALL""", "generations", "items"))
def custom_verifier(spark, d):
    """A check and an extractor of the user's own, over all samples: the truth is named somewhere; the first number is the answer."""
    answers.register_verifier("names_it", lambda out, truth: out.contains(truth), lambda out: F.nullif(F.regexp_extract(out, "[0-9]+", 0), F.lit("")))
    items = fx.items(spark, d).withColumn("verifier", F.when(F.col("verifier").isNotNull(), "names_it"))
    graded = pairing.grade_generations(items, fx.generations(spark, d))
    return graded.groupBy("task_type", "model").agg(
        F.count_if("passed").alias("passes"), F.count_if(F.col("passed").isNull()).alias("ungraded"),
        F.count_distinct(answers.extract_answer(F.lit("names_it"), F.col("text"))).alias("answers"))
