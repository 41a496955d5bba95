"""Cascade sweeps, policies and routed traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import costing, routing
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.planning_queries import _AGREE, _ANSWERS, _MASK, _PASSED
from plumbline.plans.registry import registered

FLOOR = 0.80


@registered("select_split", o.query("SELECT slug, model FROM records WHERE split='dev'", "records"))
def select_split(spark, d):
    return routing.select_split(fx.records_long(spark, d), "dev").select("slug", "model")


@registered("gradable", o.query("SELECT slug, task_type FROM items WHERE task_type IN ('math_word_problem','multiple_choice')", "items"))
def gradable(spark, d):
    return routing.gradable(fx.items(spark, d)).select("slug", "task_type")


@registered("free_form", o.query("SELECT slug, task_type FROM items WHERE task_type NOT IN ('math_word_problem','multiple_choice')", "items"))
def free_form(spark, d):
    return routing.free_form(fx.items(spark, d)).select("slug", "task_type")


@registered("assert_disjoint", o.query(
    """SELECT (SELECT count(*) FROM both_sides) AS overlap, coalesce((SELECT string_agg(slug,',' ORDER BY slug) FROM (SELECT slug FROM both_sides ORDER BY slug LIMIT 5)),'') AS examples,
       (SELECT count(*) FROM both_sides)>0 AS leak""", "items",
    both_sides="SELECT slug FROM items WHERE split='dev' INTERSECT SELECT 'item-'||l_orderkey FROM lineitem"))
def assert_disjoint(spark, d):
    """Do items of the fitting split turn up in another table? They do, and the guard says so."""
    shipped = fx.load(spark, d, "lineitem").select(F.concat(F.lit("item-"), "l_orderkey").alias("slug"))
    found = routing.assert_disjoint(routing.select_split(fx.items(spark, d), "dev"), shipped)
    return found.withColumn("examples", F.array_join("examples", ","))


_EVIDENCE = f"""SELECT a.slug, a.model, {_PASSED.replace('ground_truth::DOUBLE', 'try_cast(ground_truth AS DOUBLE)')} AS success FROM answers a JOIN used u ON a.slug=u.slug AND a.model=u.model AND u.samples>0 WHERE replicate_idx=0"""
_STATUS = """SELECT i.slug, CASE WHEN i.verifier IS NULL THEN 'not_gradable' WHEN count(e.success)<>3 THEN 'incomplete'
  WHEN max(CASE WHEN e.model='m-small' AND u.samples>1 THEN g.agreement END) IS NULL THEN 'no_agreement' END AS skip_reason, count(e.success) AS found
  FROM items i LEFT JOIN evidence e USING (slug) LEFT JOIN used u ON u.slug=e.slug AND u.model=e.model LEFT JOIN agree g ON g.slug=e.slug AND g.model=e.model GROUP BY i.slug, i.verifier"""
_RECORD_CTES = dict(used=_MASK, answers=_ANSWERS, agree=_AGREE, evidence=_EVIDENCE, status=_STATUS)


def _built(spark, d):
    items = fx.items(spark, d)
    gens = fx.generations(spark, d).join(items.select("slug", "verifier", "ground_truth"), "slug")
    samples = costing.samples_per_item(gens)
    return routing.build_records(items, samples, fx.catalog(spark), fx.LADDER)


@registered("build_records", o.query(
    """SELECT p.slug, i.task_type, i.split, p.model, success, input_tokens*input_nano+output_tokens*output_nano AS cost_nano, CASE WHEN samples>1 THEN agreement END AS agreement
       FROM parts p JOIN kept USING (slug) JOIN items i USING (slug) JOIN catalog c ON c.model=p.model""", "generations", "items", "catalog", **_RECORD_CTES,
    first="SELECT DISTINCT slug, model, input_tokens, output_tokens FROM generations WHERE replicate_idx=0",
    kept="SELECT slug FROM status WHERE skip_reason IS NULL",
    counted="SELECT e.slug, e.model, success, samples FROM evidence e JOIN used u USING (slug, model)", sized="SELECT * FROM counted JOIN first USING (slug, model)",
    parts="SELECT * FROM sized LEFT JOIN agree USING (slug, model)"))
def build_records(spark, d):
    return _built(spark, d).filter(F.col("skip_reason").isNull()).drop("skip_reason")


@registered("record_stats", o.query(
    """SELECT count(*) FILTER (skip_reason IS NULL) AS items, count(*) FILTER (skip_reason='not_gradable') AS skipped_not_gradable,
       count(*) FILTER (skip_reason='incomplete') AS skipped_incomplete, 0::BIGINT AS skipped_unpriced, count(*) FILTER (skip_reason='no_agreement') AS skipped_no_agreement,
       (sum(3-found) FILTER (skip_reason IS DISTINCT FROM 'not_gradable'))::BIGINT AS lookups_missed FROM status""", "generations", "items", **_RECORD_CTES))
def record_stats(spark, d):
    return routing.record_stats(_built(spark, d), fx.LADDER)


_INPUTS = """SELECT slug, split, bool_or(success) FILTER (model='m-small') AS cheap_ok, bool_or(success) FILTER (model='m-large') AS strong_ok,
  max(cost_nano) FILTER (model='m-small') AS cheap_nano, max(cost_nano) FILTER (model='m-large') AS strong_nano,
  CASE WHEN task_type IN ('math_word_problem','multiple_choice') THEN 3*max(cost_nano) FILTER (model='m-small') ELSE max(cost_nano) FILTER (model='m-small')+5000 END AS check_nano,
  CASE WHEN task_type IN ('math_word_problem','multiple_choice') THEN max(agreement) ELSE max(verifier_confidence) END AS confidence
  FROM records WHERE model IN ('m-small','m-large') GROUP BY slug, split, task_type"""
_POINTS = f"""SELECT split, threshold, count(*) AS n, count(*) FILTER (confidence<threshold) AS escalated,
  count(*) FILTER (CASE WHEN confidence<threshold THEN strong_ok ELSE cheap_ok END) AS served_ok,
  sum(check_nano+CASE WHEN confidence<threshold THEN strong_nano ELSE 0 END)::BIGINT AS cost_nano, count(*) FILTER (strong_ok) AS strong_ok, sum(strong_nano)::BIGINT AS strong_nano,
  count(*) FILTER (cheap_ok) AS cheap_ok, sum(cheap_nano)::BIGINT AS cheap_nano,
  count(*) FILTER (NOT confidence<threshold AND cheap_ok AND NOT strong_ok) AS b, count(*) FILTER (NOT confidence<threshold AND strong_ok AND NOT cheap_ok) AS c
  FROM inputs, {o.grid_values(routing.SWEEP_GRID)} GROUP BY split, threshold"""


def _inputs(spark, d):
    return routing.cascade_inputs(fx.records_long(spark, d), fx.CHEAP, fx.STRONG, 3, 5000)


@registered("cascade_outcomes", o.query("SELECT * FROM points", "records", inputs=_INPUTS, points=_POINTS))
def cascade_outcomes(spark, d):
    return routing.cascade_outcomes(_inputs(spark, d))


_R = lambda col: f"round_even({col}/p.n::DOUBLE,6)"
_SWEEP = f"""SELECT p.split, p.threshold, p.n, served_ok/p.n::DOUBLE AS quality, cost_nano/p.n::DOUBLE AS mean_cost_nano, escalated/p.n::DOUBLE AS escalation_rate,
  cost_nano/strong_nano::DOUBLE AS cost_ratio, {o.outcome(_R('low'), _R('high'))} AS outcome, (p.b-p.c)/p.n::DOUBLE AS effect, low/p.n::DOUBLE AS ci_low, high/p.n::DOUBLE AS ci_high,
  {o.mcnemar_p('p.b', 'p.c')} AS mcnemar_p, {o.outcome(_R('low'), _R('high'))} IN ('EQUIVALENT','IMPROVEMENT') AS eligible,
  strong_ok/p.n::DOUBLE AS baseline_quality, strong_nano/p.n::DOUBLE AS baseline_mean_cost_nano, 1.0-cost_nano/strong_nano::DOUBLE AS savings
  FROM points p JOIN bounds USING (split, threshold)"""
_SWEPT = dict(inputs=_INPUTS, points=_POINTS, **o.interval_ctes("points", ["split", "threshold"], resamples=4000), swept=_SWEEP)


def _sweep(spark, d):
    return routing.sweep(_inputs(spark, d))


@registered("sweep", o.query("SELECT * FROM swept", "records", **_SWEPT))
def sweep(spark, d):
    return _sweep(spark, d)


@registered("pareto_frontier", o.query(
    """SELECT split, threshold, mean_cost_nano, quality FROM (SELECT *, max(quality) OVER (PARTITION BY split ORDER BY mean_cost_nano, quality DESC, threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM swept)
       WHERE best IS NULL OR quality>best""", "records", **_SWEPT))
def pareto_frontier(spark, d):
    return routing.pareto_frontier(_sweep(spark, d)).select("split", "threshold", "mean_cost_nano", "quality")


_CHOSEN = """SELECT s.split, e.eligible_points, c.threshold, c.quality, c.mean_cost_nano, c.cost_ratio FROM (SELECT DISTINCT split FROM swept) s
  JOIN (SELECT split, count(*) FILTER (eligible) AS eligible_points FROM swept GROUP BY split) e USING (split)
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY split ORDER BY mean_cost_nano, quality DESC, threshold) AS rk FROM swept WHERE eligible) c ON c.split=s.split AND c.rk=1"""


@registered("operating_point", o.query("SELECT * FROM chosen", "records", **_SWEPT, chosen=_CHOSEN))
def operating_point(spark, d):
    return routing.operating_point(_sweep(spark, d))


def _policy_ctes(where: str, prefix: str = "") -> dict[str, str]:
    ev = f"SELECT task_type AS route_key, model, rung, count(*) AS n, count(*) FILTER (success) AS b, 0::BIGINT AS c FROM records WHERE {where} GROUP BY ALL"
    iv = {f"{prefix}{k}": v for k, v in o.interval_ctes(f"{prefix}ev", ["route_key", "model"], resamples=4000).items()}
    for name in ("spread2", "spread", "masses", "cdf"):
        iv = {k: v.replace(f"FROM {name} ", f"FROM {prefix}{name} ").replace(f"FROM {name}", f"FROM {prefix}{name}") if prefix and k != f"{prefix}{name}" else v for k, v in iv.items()}
    rates = f"SELECT e.route_key, e.model, e.rung, n AS n_items, e.b/n::DOUBLE AS quality, low/n::DOUBLE AS ci_low, high/n::DOUBLE AS ci_high FROM {prefix}ev e JOIN {prefix}bounds USING (route_key, model)"
    return {f"{prefix}ev": ev, **iv, f"{prefix}rates": rates}


def _walk(rates: str, cond: str = "true", models: str = "true") -> str:
    return f"""SELECT s.route_key, coalesce(w.model,'m-large') AS assigned_model, s.n_items, coalesce(w.quality,0.0) AS quality, coalesce(w.ci_low,0.0) AS ci_low, coalesce(w.ci_high,0.0) AS ci_high, {FLOOR}::DOUBLE AS floor,
      CASE WHEN s.n_items<25 THEN 'thin' WHEN w.model IS NOT NULL THEN 'cleared' ELSE 'none_cleared' END AS reason, 25::BIGINT AS min_items, CASE WHEN s.n_items<25 THEN 0 ELSE s.k END AS rungs_considered
      FROM (SELECT route_key, max(n_items) AS n_items, count(*) AS k FROM {rates} WHERE {models} GROUP BY route_key) s
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY route_key ORDER BY rung) AS rk FROM {rates} WHERE ci_low>={FLOOR} AND n_items>=25 AND {models} AND {cond}) w ON w.route_key=s.route_key AND w.rk=1"""


_DEV = _policy_ctes("split='dev'")


def _policy(spark, d):
    return routing.fit_offline_policy(routing.select_split(fx.records_long(spark, d), "dev"), fx.LADDER, fx.STRONG, FLOOR)


@registered("fit_offline_policy", o.query("SELECT * FROM policy", "records", **_DEV, policy=_walk("rates")))
def fit_offline_policy(spark, d):
    return _policy(spark, d)


@registered("ladder_walk", o.query("SELECT * FROM policy", "records", **{
    **_DEV, "rates": "SELECT route_key, model, rung, n AS n_items, b/n::DOUBLE AS quality, b/n::DOUBLE-0.02 AS ci_low, b/n::DOUBLE+0.02 AS ci_high FROM ev"},
    policy=_walk("rates")))
def ladder_walk(spark, d):
    """The walk itself, over plain bounds of two points around each rate."""
    evidence = routing.route_evidence(routing.select_split(fx.records_long(spark, d), "dev"), fx.LADDER)
    rate = F.col("k") / F.col("n")
    bounds = evidence.withColumn("quality", rate).withColumn("ci_low", rate - 0.02).withColumn("ci_high", rate + 0.02)
    return routing.ladder_walk(bounds, fx.LADDER, fx.STRONG, FLOOR)


_FAMILY = """SELECT task_type AS route_key, model, count(*) FILTER (NOT r AND s) AS b, count(*) FILTER (r AND NOT s) AS c FROM (
  SELECT task_type, model, success AS s, bool_or(CASE WHEN model='m-large' THEN success END) OVER (PARTITION BY slug) AS r FROM records WHERE split='dev') WHERE model<>'m-large' GROUP BY ALL"""
_TESTS = f"SELECT route_key, model, {o.mcnemar_p('b', 'c')} AS p_value FROM family"
_QVALUES = """SELECT route_key, model, p_value, family_size, round(least(1.0,min(p_value*family_size/rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)),8) AS q_value FROM (
  SELECT *, row_number() OVER (ORDER BY p_value, route_key, model) AS rk, count(*) OVER () AS family_size FROM tests)"""


@registered("policy_tests", o.query("SELECT * FROM qvalues", "records", family=_FAMILY, tests=_TESTS, qvalues=_QVALUES))
def policy_tests(spark, d):
    return routing.policy_tests(routing.select_split(fx.records_long(spark, d), "dev"), fx.LADDER, fx.STRONG)


@registered("bh_gate", o.query("SELECT * FROM policy", "records", **_DEV, family=_FAMILY, tests=_TESTS, qvalues=_QVALUES,
                               gated="SELECT r.*, q_value FROM rates r LEFT JOIN qvalues USING (route_key, model) WHERE r.model<>'m-large'",
                               policy=_walk("gated", "coalesce(q_value<=0.05,false)")))
def bh_gate(spark, d):
    return routing.bh_gate(routing.select_split(fx.records_long(spark, d), "dev"), fx.LADDER, fx.STRONG, fx.STRONG, FLOOR)


_SERVED = """SELECT {by} count(*) AS n, sum(cost_nano)/count(*)::DOUBLE AS mean_cost_nano, count(*) FILTER (success)/count(*)::DOUBLE AS quality
  FROM records r JOIN policy p ON r.task_type=p.route_key AND r.model=p.assigned_model {where} {group}"""


@registered("policy_cost", o.query(_SERVED.format(by="split,", where="", group="GROUP BY split"), "records", **_DEV, policy=_walk("rates")))
def policy_cost(spark, d):
    return routing.policy_cost(fx.records_long(spark, d), _policy(spark, d), ["split"])


@registered("policy_overview", o.query(
    "SELECT count(*) AS routes, count(*) FILTER (ci_low>=floor) AS cleared, min_by(assigned_model, route_key) FILTER (ci_low>=floor) AS first_cleared_model FROM policy",
    "records", **_DEV, policy=_walk("rates")))
def policy_overview(spark, d):
    return routing.policy_overview(_policy(spark, d))


@registered("fit_and_report", o.query(
    """SELECT c.threshold AS chosen_threshold, h.quality AS held_out_quality, h.cost_ratio AS held_out_cost_ratio, h.outcome AS held_out_outcome, h.n AS held_out_n,
       v.mean_cost_nano AS policy_mean_cost_nano, v.quality AS policy_quality, b.m AS strong_mean_cost_nano, v.mean_cost_nano/b.m AS policy_cost_ratio,
       CASE WHEN c.threshold IS NULL THEN 'no threshold was shown non-inferior; keep the strong model' END AS refusal
       FROM (SELECT * FROM chosen WHERE split='dev') c LEFT JOIN (SELECT * FROM swept WHERE split='test') h ON h.threshold=c.threshold, served v,
       (SELECT sum(cost_nano)/count(*)::DOUBLE AS m FROM records WHERE split='test' AND model='m-large') b""",
    "records", **_SWEPT, chosen=_CHOSEN, **_policy_ctes("split='dev'", "p_"), policy=_walk("p_rates"),
    served=_SERVED.format(by="", where="WHERE r.split='test'", group="")))
def fit_and_report(spark, d):
    return routing.fit_and_report(fx.records_long(spark, d), fx.CHEAP, fx.STRONG, fx.LADDER, fx.STRONG, FLOOR, verifier_cost_nano=5000)


_ROUTES = "SELECT event_type AS route_key, CASE WHEN avg(value)>20 THEN 'm-mid' ELSE 'm-small' END AS assigned_model FROM events WHERE event_type<>'view' GROUP BY event_type"
_ROUTED = """SELECT request_id, reason, CASE WHEN reason='explicit_model' THEN model WHEN reason='policy_route' THEN assigned_model ELSE 'm-large' END AS model_served,
  CASE WHEN reason IN ('unknown_route','policy_route') THEN k END AS route_key FROM (
  SELECT q.*, r.assigned_model, CASE WHEN model<>'auto' THEN 'explicit_model' WHEN coalesce(CASE WHEN lower(trim(mode_header)) IN ('off','offline','cascade') THEN lower(trim(mode_header)) END,'offline')='off' THEN 'router_off'
    WHEN k IS NULL THEN 'no_route_hint' WHEN r.assigned_model IS NULL THEN 'unknown_route' ELSE 'policy_route' END AS reason
  FROM (SELECT *, nullif(trim(route_hint),'') AS k FROM requests) q LEFT JOIN routes r ON r.route_key=q.k)"""


def routes_from_events(spark, d):
    return fx.load(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("route_key")).agg(
        F.when(F.avg("value") > 20, fx.MID).otherwise(fx.CHEAP).alias("assigned_model"))


@registered("route_traffic", o.query("SELECT * FROM routed", "requests", routes=_ROUTES, routed=_ROUTED))
def route_traffic(spark, d):
    routed = routing.route_traffic(fx.requests(spark, d), routes_from_events(spark, d), "offline", fx.STRONG, fx.STRONG)
    return routed.select("request_id", "reason", "model_served", "route_key")


@registered("route_traffic_no_policy", o.query(
    """SELECT reason, model_served, count(*) AS requests FROM (SELECT CASE WHEN model<>'auto' THEN 'explicit_model'
       WHEN coalesce(CASE WHEN lower(trim(mode_header)) IN ('off','offline','cascade') THEN lower(trim(mode_header)) END,'offline')='off' THEN 'router_off' ELSE 'no_policy' END AS reason,
       CASE WHEN model<>'auto' THEN model ELSE 'm-large' END AS model_served FROM requests) GROUP BY ALL""", "requests"))
def route_traffic_no_policy(spark, d):
    routed = routing.route_traffic(fx.requests(spark, d), None, "offline", fx.STRONG)
    return routed.groupBy("reason", "model_served").agg(F.count(F.lit(1)).alias("requests"))
