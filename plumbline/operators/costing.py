"""Run planning and run accounting: tasks, cache matches, projections, summaries, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import answers, money, text
from plumbline.operators.ranking import join_shuffled, running_total

# ---- fixed values -------------------------------------------------------------------------
ASSUMED_OUTPUT_TOKENS = {
    "math_word_problem": 650,
    "multiple_choice": 650,
    "summarization": 220,
    "long_form_qa": 420,
    "support_reply": 260,
}
OTHER_OUTPUT_TOKENS = 300
# -------------------------------------------------------------------------------------------


def price_usage(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``cost_nano`` and ``cost_error``. A row without a verified price has no cost.

    The catalogue is joined without a hint: Spark broadcasts it when its size allows.
    """
    prices = catalog.select(
        F.col("model"), *[F.col(f"{f.removesuffix('_tokens')}_nano").alias(f"_p_{f.removesuffix('_tokens')}_nano")
                          for f in money.USAGE_FIELDS],
    )
    joined = usage.join(prices, "model", "left")
    for field in money.USAGE_FIELDS:
        if field not in usage.columns:
            joined = joined.withColumn(field, F.lit(0).cast("bigint"))
    error = money.usage_cost_error("_p_")
    priced = joined.withColumn("cost_error", error).withColumn(
        "cost_nano", F.when(error.isNull(), money.usage_cost("_p_"))
    )
    return priced.select(*usage.columns, "cost_nano", "cost_error")


def replicate_map(items: DataFrame, subset: int, k: int) -> DataFrame:
    """(slug, replicates): the first ``subset`` slugs in order get k samples, the others one."""
    slugs = items.select("slug").distinct()
    chosen = slugs.orderBy("slug").limit(subset).withColumn("_extra", F.lit(k))
    return slugs.join(chosen, "slug", "left").select("slug", F.coalesce("_extra", F.lit(1)).alias("replicates"))


def build_tasks(items: DataFrame, models: Sequence[str], replicates: DataFrame | None = None) -> DataFrame:
    """One row per (item, model, replicate). The model list is exploded per item, never cross-joined."""
    reps = join_shuffled(items, replicates, "slug", "left") if replicates is not None else items.withColumn("replicates", F.lit(1))
    ladder = F.array(*[F.lit(m) for m in models])
    return (
        reps.select(*items.columns, F.posexplode(ladder).alias("model_pos", "model"),
                    F.coalesce("replicates", F.lit(1)).alias("_k"))
        .withColumn("replicate_idx", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .drop("_k")
    )


def in_task_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("slug", "model_pos", "replicate_idx")


def pending_tasks(tasks: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return join_shuffled(tasks, cache.select(key), key, "left_anti")


def cached_tasks(tasks: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return join_shuffled(tasks, cache.select(key), key, "left_semi")


def cache_stats(lookups: DataFrame, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    hits, total = F.count_if(hit), F.count(F.lit(1))
    return lookups.groupBy(*by).agg(
        hits.alias("hits"), (total - hits).alias("misses"),
        F.when(total > 0, hits / total).otherwise(0.0).alias("hit_rate"),
    )


def assumed_output_tokens(task_type: Column, model_max: Column) -> Column:
    assumed = None
    for task, tokens in ASSUMED_OUTPUT_TOKENS.items():
        assumed = (F if assumed is None else assumed).when(task_type == task, F.lit(tokens))
    return F.least(assumed.otherwise(F.lit(OTHER_OUTPUT_TOKENS)), model_max)


def project_cost(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls, tokens and nano-USD a run would need, per model.

    ``items``: task_type, prompt_chars, replicates. Items shrink to one row per (task, token
    estimate) before they meet the models, so the items are read and shuffled once.
    """
    per_size = items.groupBy("task_type", text.token_estimate(F.col("prompt_chars")).alias("in_tokens")).agg(
        F.sum("replicates").alias("calls")
    )
    per_task = per_size.groupBy("task_type").agg(
        F.sum("calls").alias("calls"), F.sum(F.col("calls") * F.col("in_tokens")).alias("input_tokens")
    )
    ladder = catalog.agg(F.collect_list(F.struct(*catalog.columns)).alias("_ladder"), F.lit(1).alias("_one"))
    per_model = (
        per_task.withColumn("_one", F.lit(1)).join(ladder, "_one")
        .withColumn("_m", F.explode("_ladder"))
        .withColumn("_out", assumed_output_tokens(F.col("task_type"), F.col("_m.max_output_tokens")))
        .groupBy(F.col("_m.model").alias("model"), F.col("_m.input_nano").alias("_in"), F.col("_m.output_nano").alias("_o"))
        .agg(
            F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
            F.sum(F.col("calls") * F.col("_out")).alias("output_tokens"),
        )
    )
    return per_model.select(
        "model", "calls", "input_tokens", "output_tokens",
        (F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_o")).alias("cost_nano"),
    )


def projected_vs_actual(projected: DataFrame, actual: DataFrame, cap_nano: int | None = None) -> DataFrame:
    """Per model: projected and actual nano, their ratio (0 when nothing was projected), cap flag."""
    joined = projected.select("model", F.col("cost_nano").alias("projected_nano")).join(
        actual.select("model", F.col("cost_nano").alias("actual_nano")), "model"
    )
    ratio = F.when(F.col("projected_nano") == 0, 0.0).otherwise(F.col("actual_nano") / F.col("projected_nano"))
    out = joined.withColumn("actual_over_projected", ratio)
    if cap_nano is not None:
        out = out.withColumn("within_cap", F.col("projected_nano") <= cap_nano)
    return out


def median_output_tokens(observed: DataFrame) -> DataFrame:
    """Median output tokens per task, cut to an integer, to replace the assumptions.

    Values are counted first, so the median sees distinct token counts only.
    """
    counts = observed.groupBy("task_type", "output_tokens").agg(F.count(F.lit(1)).alias("_w"))
    return counts.groupBy("task_type").agg(
        F.percentile("output_tokens", F.lit(0.5), F.col("_w")).cast("bigint").alias("median_output_tokens")
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per model: calls, tokens, cost, pass rate and median latency of a run.

    Tokens count successful rows only; cost counts all that have a price, and ``unpriced`` those that have none;
    cache hits cost nothing and stay out of the latency median.
    """
    ok = F.col("error_kind").isNull()
    graded = ok & F.col("passed").isNotNull()
    timed = ok & ~F.col("from_cache") & (F.col("latency_ms") > 0)
    cost = F.when(F.col("from_cache"), F.lit(0)).otherwise(F.coalesce("cost_nano", F.lit(0)))
    totals = outcomes.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls_attempted"),
        F.count_if(ok).alias("calls_succeeded"),
        F.count_if(~ok).alias("calls_failed"),
        F.count_if(F.col("from_cache")).alias("cache_hits"),
        F.sum(F.when(ok, F.col("input_tokens")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(ok, F.col("output_tokens")).otherwise(0)).alias("output_tokens"),
        F.sum(cost).alias("cost_nano"),
        F.count_if(~F.col("from_cache") & F.col("cost_nano").isNull()).alias("unpriced"),
        F.count_if(ok & ~F.col("usage_is_final")).alias("unconfirmed_usage_calls"),
        F.count_if(graded & F.col("passed")).alias("_passed"),
        F.count_if(graded).alias("graded_n"),
    )
    latency = outcomes.filter(timed).groupBy("model", "latency_ms").agg(F.count(F.lit(1)).alias("_w"))
    medians = latency.groupBy("model").agg(
        F.percentile("latency_ms", F.lit(0.5), F.col("_w")).cast("bigint").alias("median_latency_ms")
    )
    return (
        totals.join(medians, "model", "left")
        .withColumn("pass_rate", F.when(F.col("graded_n") > 0, F.col("_passed") / F.col("graded_n")))
        .drop("_passed")
    )


def errors_by_kind(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("error_kind").isNotNull()).groupBy("error_kind").agg(F.count(F.lit(1)).alias("errors"))


def cumulative_spend(traces: DataFrame, cap_nano: int, by: Sequence[str], ts: str = "created_at", key: str = "id") -> DataFrame:
    """Running spend per ``by`` in time order, what is left of the cap, and whether it is exceeded.

    A row without a price adds nothing and is marked ``unpriced``: from there on the spend is a lower bound.
    """
    running = running_total(traces, by, ts, [key], F.coalesce("cost_nano", F.lit(0)), "spent_nano")
    return running.withColumn("unpriced", F.col("cost_nano").isNull()).withColumn(
        "remaining_nano", F.greatest(F.lit(0), F.lit(cap_nano) - F.col("spent_nano"))
    ).withColumn("over_cap", F.col("spent_nano") > cap_nano)


def first_over_cap(traces: DataFrame, cap_nano: int, by: Sequence[str], ts: str = "created_at", key: str = "id") -> DataFrame:
    """The row that crosses the cap in each ``by`` group, if any."""
    over = cumulative_spend(traces, cap_nano, by, ts, key).filter("over_cap")
    first = F.min_by(F.struct(F.col(key), F.col(ts), F.col("spent_nano")), F.struct(F.col(ts), F.col(key)))
    return over.groupBy(*by).agg(first.alias("_first")).select(*by, "_first.*")


def samples_per_item(gens: DataFrame) -> DataFrame:
    """One row per (slug, model): usable replicates, agreement, and the graded first sample.

    ``gens`` carries the verifier and ground truth of its item. Texts are read where they lie: only the
    answer of each sample is shuffled, first grouped by replicate (repeated copies of a sample count once,
    the largest answer if copies differ), then counted by answer among the replicates before the first gap.
    Any number of replicates is exact; no group is collected.
    """
    idx = F.col("replicate_idx")
    answer = answers.extract_answer(F.col("verifier"), F.col("text"))
    first = lambda c: F.max(F.when(idx == 0, c))
    once = gens.filter(idx >= 0).select(
        "slug", "model", idx, "input_tokens", "output_tokens", answer.alias("_answer"),
        F.when(idx == 0, answers.verify(F.col("verifier"), F.col("text"), F.col("ground_truth"))).alias("_passed"),
    ).groupBy("slug", "model", idx).agg(
        F.max("_answer").alias("_answer"), F.max("_passed").alias("_passed"),
        F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"))
    usable = _before_first_gap(once)
    # A sample nobody can read is an answer of its own.
    alone = F.when(F.col("_answer").isNull(), idx)
    counted = usable.groupBy("slug", "model", "_answer", alone.alias("_alone")).agg(
        F.count_if("_usable").alias("_n"), first(F.col("_passed")).alias("success"), first(F.col("input_tokens")).alias("input_tokens"),
        first(F.col("output_tokens")).alias("output_tokens"))
    samples = F.sum("_n")
    return counted.groupBy("slug", "model").agg(
        samples.cast("int").alias("samples"), F.when(samples > 1, F.max("_n") / samples).alias("agreement"),
        F.max("success").alias("success"), F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"))


def _before_first_gap(once: DataFrame) -> DataFrame:
    """Adds ``_usable`` to rows of distinct replicates: an index equals its rank exactly before the first gap."""
    rank = F.row_number().over(Window.partitionBy("slug", "model").orderBy("replicate_idx")) - 1
    return once.withColumn("_usable", F.col("replicate_idx") == rank)


def contiguous_replicates(gens: DataFrame) -> DataFrame:
    """Replicates used per (slug, model): those before the first missing index."""
    once = gens.filter(F.col("replicate_idx") >= 0).select("slug", "model", "replicate_idx").distinct()
    return _before_first_gap(once).groupBy("slug", "model").agg(F.count_if("_usable").cast("int").alias("samples"))


def cheapest_first(catalog: DataFrame) -> DataFrame:
    """The ladder: models by input price, then name."""
    return catalog.orderBy("input_nano", "model")


def models_at_rung(catalog: DataFrame, rung: str) -> DataFrame:
    return catalog.filter(F.col("rung") == rung).orderBy("input_nano", "model")


