"""Cascade sweeps, route policies and request routing.

A sweep never visits a record once per threshold. Each record falls into one confidence bucket of
the grid; counts per bucket are a handful of rows, and every threshold is a sum over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import stats
from plumbline.operators import pairing

# ---- fixed values -------------------------------------------------------------------------
GRADABLE_TASKS = ("math_word_problem", "multiple_choice")
SWEEP_GRID = tuple(round(i / 20, 3) for i in range(21))
FIT_SPLIT, REPORT_SPLIT = "dev", "test"
MIN_ROUTE_ITEMS = 25
ROUTER_MODES = ("off", "offline", "cascade")
# -------------------------------------------------------------------------------------------


def select_split(records: DataFrame, split: str) -> DataFrame:
    return records.filter(F.col("split") == split)


def is_gradable(task_type: Column) -> Column:
    return task_type.isin(*GRADABLE_TASKS)


def gradable(df: DataFrame) -> DataFrame:
    return df.filter(is_gradable(F.col("task_type")))


def free_form(df: DataFrame) -> DataFrame:
    return df.filter(~is_gradable(F.col("task_type")))


def assert_disjoint(fit: DataFrame, report: DataFrame) -> DataFrame:
    """One row: how many items are on both sides and up to five of them; ``leak`` says it is fatal."""
    common = fit.select("slug").intersect(report.select("slug"))
    examples = common.orderBy("slug").limit(5).agg(F.array_sort(F.collect_list("slug")).alias("examples"))
    counted = common.agg(F.count(F.lit(1)).alias("overlap"))
    return (
        counted.withColumn("_one", F.lit(1)).join(examples.withColumn("_one", F.lit(1)), "_one").drop("_one")
        .withColumn("leak", F.col("overlap") > 0)
    )


def require_disjoint(fit: DataFrame, report: DataFrame) -> None:
    row = assert_disjoint(fit, report).first()
    if row["leak"]:
        raise ValueError(f"{row['overlap']} item(s) are in both the fitting and the reporting set, e.g. {row['examples']}")


def require_one_split(records: DataFrame) -> None:
    """The same guard for a table that holds both sides: no item may carry two splits."""
    per_item = records.groupBy("slug").agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
    shared = per_item.filter(F.col("_a") != F.col("_b")).select("slug").orderBy("slug").limit(5).collect()
    if shared:
        raise ValueError(f"items in more than one split, e.g. {[r['slug'] for r in shared]}")


def _require_splits(records: DataFrame) -> None:
    """A fit needs rows to choose from and rows to report on."""
    met = {r["split"] for r in records.select("split").distinct().collect()}
    if missing := [s for s in (FIT_SPLIT, REPORT_SPLIT) if s not in met]:
        raise ValueError(f"no records in split {missing}")


def build_records(items: DataFrame, samples: DataFrame, catalog: DataFrame, models: Sequence[str],
                  require_agreement: bool = True) -> DataFrame:
    """Per item: why it is skipped, or its long-form evidence for every model.

    ``samples`` is the output of ``samples_per_item``. Returns one row per (slug, model) with
    ``skip_reason``; NULL marks usable rows. The first model is the cheap one whose agreement counts.
    """
    from plumbline.operators.costing import price_usage

    graded_items = items.withColumn("_gradable", F.col("verifier").isNotNull() & F.col("ground_truth").isNotNull())
    found = samples.filter(F.col("model").isin(*models) & (F.col("samples") > 0))
    priced = price_usage(graded_items.join(found, "slug", "left"), catalog)
    # An item has one row per model by now, so this window never holds more than the ladder.
    of_item = Window.partitionBy("slug")
    cheap_agreement = F.when(F.col("model") == models[0], F.col("agreement"))
    status = priced.withColumn("_n_models", F.count("success").over(of_item)).withColumn("_n_priced", F.count("cost_nano").over(of_item)).withColumn(
        "_cheap_agreement", F.max(cheap_agreement).over(of_item))
    reason = (
        F.when(~F.col("_gradable"), F.lit("not_gradable"))
        .when(F.col("_n_models") != len(models), F.lit("incomplete"))
        .when(F.col("_n_priced") != len(models), F.lit("unpriced"))
    )
    if require_agreement:
        reason = reason.when(F.col("_cheap_agreement").isNull(), F.lit("no_agreement"))
    return status.select(
        "slug", "task_type", "split", "model", "success", "cost_nano", "agreement", reason.alias("skip_reason"))


def record_stats(records: DataFrame, models: Sequence[str]) -> DataFrame:
    """Items kept, items skipped by reason, and model lookups that found nothing."""
    per_item = records.groupBy("slug").agg(
        F.first("skip_reason").alias("skip_reason"), F.count("success").alias("found"))
    reason = F.col("skip_reason")
    gradable_item = reason.isNull() | (reason != "not_gradable")
    return per_item.agg(
        F.count_if(reason.isNull()).alias("items"),
        F.count_if(reason == "not_gradable").alias("skipped_not_gradable"),
        F.count_if(reason == "incomplete").alias("skipped_incomplete"),
        F.count_if(reason == "unpriced").alias("skipped_unpriced"),
        F.count_if(reason == "no_agreement").alias("skipped_no_agreement"),
        F.coalesce(F.sum(F.when(gradable_item, F.lit(len(models)) - F.col("found"))), F.lit(0)).alias("lookups_missed"),
    )


def confidence() -> Column:
    """Escalation signal: agreement where answers are gradable, else the verifier's score."""
    value = F.when(is_gradable(F.col("task_type")), F.col("agreement")).otherwise(F.col("verifier_confidence"))
    missing = F.concat(F.col("slug"), F.lit(": no confidence recorded for this item"))
    return F.coalesce(value, F.raise_error(missing).cast("double"))


def cascade_inputs(records: DataFrame, cheap: str, strong: str, k_samples: int = 3,
                   verifier_cost_nano: int = 0, by: Sequence[str] = ("split",)) -> DataFrame:
    """Long records to one row per item: both arms' results and the price of checking confidence."""
    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    wide = records.filter(F.col("model").isin(cheap, strong)).groupBy("slug", "task_type", *by).agg(
        of(cheap, "success").alias("cheap_ok"), of(strong, "success").alias("strong_ok"),
        of(cheap, "cost_nano").alias("cheap_nano"), of(strong, "cost_nano").alias("strong_nano"),
        of(cheap, "agreement").alias("agreement"), of(cheap, "verifier_confidence").alias("verifier_confidence"),
    )
    def arm(model: str, column: str, name: str) -> Column:
        missing = F.concat(F.col("slug"), F.lit(f": no {column} of {model}"))
        return F.coalesce(F.col(name), F.raise_error(missing).cast(wide.schema[name].dataType)).alias(name)

    # An item that lacks an arm or its price would count as concordant or free: refuse it.
    wide = wide.select(*[arm(m, c, n) if n in ("cheap_ok", "strong_ok", "cheap_nano", "strong_nano") else F.col(n)
                         for n in wide.columns for m, c in [(cheap if n.startswith("cheap") else strong, "success" if n.endswith("ok") else "cost_nano")]])
    check = F.when(is_gradable(F.col("task_type")), F.col("cheap_nano") * k_samples).otherwise(
        F.col("cheap_nano") + verifier_cost_nano)
    return wide.select(*by, "slug", "cheap_ok", "strong_ok", "cheap_nano", "strong_nano",
                       check.alias("check_nano"), confidence().alias("confidence"))


def grid_bucket(score: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of the ascending grid are at or below the score."""
    bucket = F.lit(0)
    for t in grid:
        bucket = bucket + (score >= F.lit(float(t))).cast("int")
    return bucket


def at_thresholds(bucketed: DataFrame, grid: Sequence[float], by: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """Each bucket row once per threshold, with ``below``: its scores are strictly under it."""
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("_at")) for i, t in enumerate(grid)])
    return bucketed.select("*", F.inline(points)).withColumn("below", F.col(bucket) <= F.col("_at")).drop("_at")


def cascade_outcomes(inputs: DataFrame, grid: Sequence[float] = SWEEP_GRID, by: Sequence[str] = ("split",)) -> DataFrame:
    """Counts per threshold: served successes, cost, escalations, and both baselines."""
    cheap, strong = F.col("cheap_ok"), F.col("strong_ok")
    buckets = inputs.groupBy(*by, grid_bucket(F.col("confidence"), grid).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(cheap).alias("cheap_ok"), F.count_if(strong).alias("strong_ok"),
        F.count_if(cheap & ~strong).alias("gain"), F.count_if(~cheap & strong).alias("loss"),
        F.sum("cheap_nano").alias("cheap_nano"), F.sum("strong_nano").alias("strong_nano"),
        F.sum("check_nano").alias("check_nano"),
    )
    up = F.col("below")
    return at_thresholds(buckets, grid, by).groupBy(*by, "threshold").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(up, F.col("n")).otherwise(0)).alias("escalated"),
        F.sum(F.when(up, F.col("strong_ok")).otherwise(F.col("cheap_ok"))).alias("served_ok"),
        F.sum(F.col("check_nano") + F.when(up, F.col("strong_nano")).otherwise(0)).alias("cost_nano"),
        F.sum("strong_ok").alias("strong_ok"), F.sum("strong_nano").alias("strong_nano"),
        F.sum("cheap_ok").alias("cheap_ok"), F.sum("cheap_nano").alias("cheap_nano"),
        F.sum(F.when(up, 0).otherwise(F.col("gain"))).alias("b"),
        F.sum(F.when(up, 0).otherwise(F.col("loss"))).alias("c"),
    )


def sweep(inputs: DataFrame, grid: Sequence[float] = SWEEP_GRID, by: Sequence[str] = ("split",),
          margin: float = stats.MARGIN, alpha: float = stats.ALPHA,
          resamples: int = stats.POLICY_RESAMPLES) -> DataFrame:
    """Every threshold against the all-strong baseline: quality, cost, interval, eligibility."""
    points = cascade_outcomes(inputs, grid, by)
    counts = points.withColumn("n11", F.col("strong_ok") - F.col("c")).withColumn(
        "n00", F.col("n") - F.col("n11") - F.col("b") - F.col("c"))
    compared = pairing.compare(counts, margin, alpha, resamples)
    n = F.col("n")
    return compared.select(
        *by, "threshold", "n", (F.col("served_ok") / n).alias("quality"),
        (F.col("cost_nano") / n).alias("mean_cost_nano"), (F.col("escalated") / n).alias("escalation_rate"),
        F.when(F.col("strong_nano") > 0, F.col("cost_nano") / F.col("strong_nano")).otherwise(0.0).alias("cost_ratio"),
        "outcome", "effect", "ci_low", "ci_high", "mcnemar_p",
        F.col("outcome").isin("EQUIVALENT", "IMPROVEMENT").alias("eligible"),
        (F.col("strong_ok") / n).alias("baseline_quality"),
        (F.col("strong_nano") / n).alias("baseline_mean_cost_nano"),
    ).withColumn("savings", F.lit(1.0) - F.col("cost_ratio"))


def pareto_frontier(points: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Points that no cheaper (or equally cheap) point matches in quality; one grid per ``by``."""
    order = Window.partitionBy(*by).orderBy("mean_cost_nano", F.col("quality").desc(), "threshold")
    best_before = F.max("quality").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_best", best_before).filter(
        F.col("_best").isNull() | (F.col("quality") > F.col("_best"))).drop("_best")


def operating_point(points: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Cheapest eligible threshold per ``by``; NULL columns where none qualifies."""
    row = F.struct(*[c for c in points.columns if c not in by])
    best = F.min_by(F.when(F.col("eligible"), row),
                    F.when(F.col("eligible"), F.struct(F.col("mean_cost_nano"), -F.col("quality"), F.col("threshold"))))
    return points.groupBy(*by).agg(best.alias("_best"), F.count_if(F.col("eligible")).alias("eligible_points")).select(
        *by, "eligible_points", F.col("_best.threshold").alias("threshold"), F.col("_best.quality").alias("quality"),
        F.col("_best.mean_cost_nano").alias("mean_cost_nano"), F.col("_best.cost_ratio").alias("cost_ratio"))


def route_evidence(records: DataFrame, models: Sequence[str], route: str = "task_type", extra: Sequence[str] = ()) -> DataFrame:
    """Per route and model: items of the route, items with a result, successes."""
    per_route = records.groupBy(*extra, F.col(route).alias("route_key"), "model").agg(
        F.count("success").alias("n"), F.count_if("success").alias("k"))
    sizes = records.select(*extra, F.col(route).alias("route_key"), "slug").distinct().groupBy(*extra, "route_key").agg(
        F.count(F.lit(1)).alias("n_items"))
    return per_route.filter(F.col("model").isin(*models)).join(sizes, [*extra, "route_key"])


def route_bounds(evidence: DataFrame, alpha: float = stats.ALPHA, resamples: int = stats.POLICY_RESAMPLES) -> DataFrame:
    bounded = evidence.filter("n > 0").withColumn("_ci", stats.rate_interval(F.col("k"), F.col("n"), alpha, resamples))
    return bounded.select(
        *evidence.columns, (F.col("k") / F.col("n")).alias("quality"),
        (F.col("_ci.low") / F.col("n")).alias("ci_low"), (F.col("_ci.high") / F.col("n")).alias("ci_high"))


def ladder_walk(bounds: DataFrame, ladder: Sequence[str], safe_default: str, floor: float,
                min_items: int = MIN_ROUTE_ITEMS, gate: Column | None = None) -> DataFrame:
    """Per route the first rung, cheapest first, whose lower bound clears the floor.

    A refusal is a row: thin routes and routes without such a rung get the safe default, zero
    metrics and the reason.
    """
    position = F.array_position(F.array(*[F.lit(m) for m in ladder]), F.col("model"))
    cleared = (F.col("ci_low") >= floor) & (F.col("n_items") >= min_items)
    if gate is not None:
        cleared = cleared & gate
    rung = F.struct("model", "quality", "ci_low", "ci_high")
    walked = bounds.groupBy("route_key").agg(
        F.max("n_items").alias("n_items"),
        F.min_by(F.when(cleared, rung), F.when(cleared, position)).alias("_rung"),
        F.count(F.lit(1)).alias("rungs_considered"),
    )
    thin = F.col("n_items") < min_items
    taken = F.col("_rung").isNotNull()
    return walked.select(
        "route_key", F.coalesce("_rung.model", F.lit(safe_default)).alias("assigned_model"), "n_items",
        F.coalesce("_rung.quality", F.lit(0.0)).alias("quality"), F.coalesce("_rung.ci_low", F.lit(0.0)).alias("ci_low"),
        F.coalesce("_rung.ci_high", F.lit(0.0)).alias("ci_high"), F.lit(float(floor)).alias("floor"),
        F.when(thin, "thin").when(taken, "cleared").otherwise("none_cleared").alias("reason"),
        F.lit(min_items).cast("long").alias("min_items"),
        F.when(thin, 0).otherwise(F.col("rungs_considered")).alias("rungs_considered"),
    )


def fit_offline_policy(records: DataFrame, ladder: Sequence[str], safe_default: str, floor: float,
                       min_items: int = MIN_ROUTE_ITEMS, alpha: float = stats.ALPHA,
                       resamples: int = stats.POLICY_RESAMPLES) -> DataFrame:
    bounds = route_bounds(route_evidence(records, ladder), alpha, resamples)
    return ladder_walk(bounds, ladder, safe_default, floor, min_items)


def policy_tests(records: DataFrame, ladder: Sequence[str], reference: str) -> DataFrame:
    """Every (route, rung) test of a fit against the reference model, with q-values over the family."""
    rungs = [m for m in ladder if m != reference]
    compared = pairing.compare_runs(records, [(reference, m) for m in rungs], ["task_type"])
    tests = compared.select(
        F.col("task_type").alias("route_key"), F.col("candidate").alias("model"), F.col("mcnemar_p").alias("p_value"),
        F.lit("fit").alias("family"))
    return pairing.bh_qvalues(tests, ["family"]).drop("family")


def bh_gate(records: DataFrame, ladder: Sequence[str], reference: str, safe_default: str, floor: float,
            alpha: float = stats.ALPHA, min_items: int = MIN_ROUTE_ITEMS) -> DataFrame:
    """Route policy that also asks for a q-value at or below alpha over all tests of the fit."""
    rungs = [m for m in ladder if m != reference]
    bounds = route_bounds(route_evidence(records, rungs))
    tested = bounds.join(policy_tests(records, ladder, reference), ["route_key", "model"], "left")
    return ladder_walk(tested, rungs, safe_default, floor, min_items, F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def policy_cost(records: DataFrame, policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cost and quality of serving the records under the policy; unmatched rows are left out."""
    served = records.join(
        policy.select(F.col("route_key").alias("task_type"), F.col("assigned_model").alias("model")), ["task_type", "model"]
    ).filter(F.col("success").isNotNull())
    n = F.count(F.lit(1))
    return served.groupBy(*by).agg(
        n.alias("n"),
        F.when(n > 0, F.sum("cost_nano") / n).otherwise(0.0).alias("mean_cost_nano"),
        F.when(n > 0, F.count_if("success") / n).otherwise(0.0).alias("quality"),
    )


def fit_and_report(records: DataFrame, cheap: str, strong: str, ladder: Sequence[str], safe_default: str, floor: float,
                   grid: Sequence[float] = SWEEP_GRID, k_samples: int = 3, verifier_cost_nano: int = 0,
                   margin: float = stats.MARGIN) -> DataFrame:
    """One row: threshold chosen on the fit split, its held-out result, and the route policy's.

    Both splits are swept in one pass; the chosen threshold is looked up in the report split's
    sweep, so it is evaluated on data that played no part in choosing it.
    """
    both = records.filter(F.col("split").isin(FIT_SPLIT, REPORT_SPLIT))
    require_one_split(both)
    _require_splits(both)
    points = sweep(cascade_inputs(both, cheap, strong, k_samples, verifier_cost_nano), grid, margin=margin)
    # The sweep is one row per split and threshold; both roles are read off it in one go.
    usable = (F.col("split") == FIT_SPLIT) & F.col("eligible")
    cheapest = F.struct(F.col("mean_cost_nano"), -F.col("quality"), F.col("threshold"))
    choice = F.min_by(F.when(usable, F.col("threshold")), F.when(usable, cheapest))
    marked = points.withColumn("chosen_threshold", choice.over(Window.partitionBy()))
    held = (F.col("split") == REPORT_SPLIT) & (F.col("threshold") == F.col("chosen_threshold"))
    result = marked.agg(
        F.max("chosen_threshold").alias("chosen_threshold"),
        *[F.max(F.when(held, F.col(c))).alias(f"held_out_{c}") for c in ("quality", "cost_ratio", "outcome", "n")],
        F.max(F.when(F.col("split") == REPORT_SPLIT, F.col("baseline_mean_cost_nano"))).alias("strong_mean_cost_nano"))
    policy = fit_offline_policy(select_split(both, FIT_SPLIT), ladder, safe_default, floor)
    served = policy_cost(select_split(both, REPORT_SPLIT), policy).select(
        F.col("mean_cost_nano").alias("policy_mean_cost_nano"), F.col("quality").alias("policy_quality"))
    one = F.lit(1).alias("_one")
    joined = result.select("*", one).join(served.select("*", one), "_one").drop("_one")
    return joined.withColumn(
        "policy_cost_ratio",
        F.when(F.col("strong_mean_cost_nano") > 0, F.col("policy_mean_cost_nano") / F.col("strong_mean_cost_nano")).otherwise(0.0),
    ).withColumn(
        "refusal", F.when(F.col("chosen_threshold").isNull(), F.lit("no threshold was shown non-inferior; keep the strong model")))


def parse_mode(header: Column) -> Column:
    """Per-request router mode; unknown values are ignored."""
    value = F.lower(F.trim(header))
    return F.when(value.isin(*ROUTER_MODES), value)


def route_traffic(requests: DataFrame, policy: DataFrame | None, default_mode: str, fallback_model: str,
                  safe_default: str | None = None, auto_model: str = "auto") -> DataFrame:
    """Adds ``model_served``, ``route_key`` and ``reason`` to requests (model, route_hint, mode_header)."""
    key = F.nullif(F.trim(F.col("route_hint")), F.lit(""))
    mode = F.coalesce(parse_mode(F.col("mode_header")), F.lit(default_mode))
    keyed = requests.withColumn("_key", key)
    if policy is None:
        joined = keyed.withColumn("_assigned", F.lit(None).cast("string"))
        strong = F.lit(fallback_model)
    else:
        joined = keyed.join(
            policy.select(F.col("route_key").alias("_key"), F.col("assigned_model").alias("_assigned")), "_key", "left")
        strong = F.lit(safe_default)
    reason = F.when(F.col("model") != auto_model, F.lit("explicit_model")).when(mode == "off", F.lit("router_off"))
    if policy is None:
        reason = reason.otherwise(F.lit("no_policy"))
    else:
        reason = (reason.when(F.col("_key").isNull(), F.lit("no_route_hint"))
                  .when(F.col("_assigned").isNull(), F.lit("unknown_route")).otherwise(F.lit("policy_route")))
    out = joined.withColumn("reason", reason)
    return out.select(
        *requests.columns,
        F.when(F.col("reason") == "explicit_model", F.col("model"))
        .when(F.col("reason") == "policy_route", F.col("_assigned")).otherwise(strong).alias("model_served"),
        F.when(F.col("reason").isin("unknown_route", "policy_route"), F.col("_key")).alias("route_key"),
        "reason",
    )


def policy_overview(policy: DataFrame) -> DataFrame:
    """Routes, how many clear the floor, and the first (by route) cleared model."""
    cleared = F.col("ci_low") >= F.col("floor")
    return policy.agg(
        F.count(F.lit(1)).alias("routes"), F.count_if(cleared).alias("cleared"),
        F.min_by(F.when(cleared, F.col("assigned_model")), F.when(cleared, F.col("route_key"))).alias("first_cleared_model"))
