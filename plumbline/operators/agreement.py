"""Judge replies to outcomes, and how well a judge agrees with people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import answers, stats

# ---- fixed values -------------------------------------------------------------------------
MIN_TASK_LABELS = 5
FLIP_LIMIT = 0.2
WEAK_RECALL = 0.5
ONE_TASK_SHARE = 0.5
FAST_LABEL_MS = 5_000
FAST_SHARE = 0.15
# -------------------------------------------------------------------------------------------

CELLS = [(h, j) for h in stats.CLASSES for j in stats.CLASSES]


def score_judge_log(replies: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Two raw replies per comparison (``position`` = the candidate's slot) to one judgment."""
    parsed = replies.withColumn("_r", answers.parse_judge_reply(F.col("raw"))).withColumn(
        "_o", answers.to_candidate_outcome(F.col("_r.outcome"), F.col("position")))

    def at(slot: str, column: str) -> Column:
        return F.max(F.when(F.col("position") == slot, F.col(column)))

    both = parsed.groupBy(*keys).agg(
        at("A", "_o").alias("outcome_a"), at("B", "_o").alias("outcome_b"),
        at("A", "_r.confidence").alias("_ca"), at("B", "_r.confidence").alias("_cb"))
    usable = F.col("outcome_a").isNotNull() & F.col("outcome_b").isNotNull()
    return both.select(
        *keys, "outcome_a", "outcome_b",
        answers.combine_positions(F.col("outcome_a"), F.col("outcome_b")).alias("outcome"),
        F.when(usable, F.col("outcome_a") != F.col("outcome_b")).otherwise(F.lit(False)).alias("position_flip"),
        (~usable).alias("unparseable"),
        F.when(usable, F.bround((F.col("_ca") + F.col("_cb")) / 2.0, 4)).alias("confidence"))


def candidate_vs_reference(pairs: DataFrame, gens: DataFrame) -> DataFrame:
    """Both texts of a comparison; a comparison lacking either is left out."""
    texts = gens.select("slug", "model", "text")
    candidate = texts.select("slug", F.col("model").alias("candidate_model"), F.col("text").alias("candidate_text"))
    reference = texts.select("slug", F.col("model").alias("reference_model"), F.col("text").alias("reference_text"))
    return pairs.join(candidate, ["slug", "candidate_model"]).join(reference, ["slug", "reference_model"])


def ground_truth_discriminable(compared: DataFrame, limit: int | None = None) -> DataFrame:
    """Comparisons where exactly one side is right, with the outcome a judge should give.

    ``limit`` keeps the first comparisons by item and model, as a checking budget would.
    """
    def passed(side: str) -> Column:
        return answers.verify(F.col("verifier"), F.col(f"{side}_text"), F.col("ground_truth"))

    usable = (
        compared.withColumn("candidate_ok", passed("candidate")).withColumn("reference_ok", passed("reference"))
        .filter(F.col("candidate_ok") != F.col("reference_ok"))
        .withColumn("expected", F.when(F.col("candidate_ok"), F.lit("win")).otherwise(F.lit("loss"))))
    return usable.orderBy("slug", "candidate_model").limit(limit) if limit is not None else usable


def judge_accuracy(usable: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    judged = F.col("outcome").isNotNull()
    n = F.count_if(judged)
    right = F.count_if(judged & (F.col("outcome") == F.col("expected")))
    return usable.groupBy(*by).agg(n.alias("n"), right.alias("correct"), F.when(n > 0, right / n).alias("accuracy"))


def join_labels_judgments(labels: DataFrame, judgments: DataFrame) -> DataFrame:
    """Labels with their judgment and a status: missing, unparseable or compared."""
    joined = labels.join(judgments.withColumn("_judged", F.lit(True)), "pair_id", "left")
    status = (
        F.when(F.col("_judged").isNull(), F.lit("missing"))
        .when(F.col("unparseable") | F.col("outcome").isNull(), F.lit("unparseable"))
        .otherwise(F.lit("compared")))
    return joined.withColumn("status", status).drop("_judged")


def cell_counts(first: str = "human", second: str = "outcome") -> list[Column]:
    return [
        F.count_if((F.col(first) == h) & (F.col(second) == j)).alias(f"{h}_{j}") for h, j in CELLS
    ]


def confusion(compared: DataFrame, by: Sequence[str] = (), first: str = "human", second: str = "outcome") -> DataFrame:
    """Nine counts per group, empty cells included."""
    return compared.groupBy(*by).agg(*cell_counts(first, second))


def confusion_long(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("human"), F.lit(j).alias("judge"), F.col(f"{h}_{j}").alias("n")) for h, j in CELLS])
    return wide.select(*by, F.inline(rows))


def agreement(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Raw agreement, kappa and recall per class from the nine counts, as single divisions."""
    c = {(h, j): F.col(f"{h}_{j}") for h, j in CELLS}
    n = sum(c.values(), F.lit(0))
    hits = sum((c[k, k] for k in stats.CLASSES), F.lit(0))
    rows = {k: sum((c[k, j] for j in stats.CLASSES), F.lit(0)) for k in stats.CLASSES}
    cols = {k: sum((c[h, k] for h in stats.CLASSES), F.lit(0)) for k in stats.CLASSES}
    chance = sum((rows[k].cast("double") * cols[k].cast("double") for k in stats.CLASSES), F.lit(0.0))
    nn = n.cast("double")
    kappa = F.when((n == 0) | (nn * nn == chance), F.lit(0.0)).otherwise((hits * nn - chance) / (nn * nn - chance))
    recalls = [
        F.when(rows[k] > 0, c[k, k] / rows[k]).otherwise(0.0).alias(f"recall_{k}") for k in stats.CLASSES
    ]
    return cells.select(
        *by, n.alias("n"), F.when(n > 0, hits / n).otherwise(0.0).alias("raw_agreement"), kappa.alias("kappa"),
        *recalls, *[F.col(f"{h}_{j}") for h, j in CELLS])


def kappa_ci(agreed: DataFrame, by: Sequence[str] = (), alpha: float = stats.ALPHA, resamples: int | None = None) -> DataFrame:
    """Adds the interval of kappa and whether its lower end clears the gate."""
    cells = F.array(*[F.col(f"{h}_{j}").cast("bigint") for h, j in CELLS])
    seed = F.concat_ws("|", F.lit("kappa"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in by])
    return agreed.withColumn("_ci", stats.kappa_interval(cells, seed, alpha, resamples)).select(
        "*", F.col("_ci.low").alias("kappa_ci_low"), F.col("_ci.high").alias("kappa_ci_high"),
        (F.col("_ci.low") >= stats.KAPPA_GATE).alias("clears_gate"),
        stats.interpret_kappa(F.col("kappa")).alias("kappa_band")).drop("_ci")


def agreement_by_task(compared: DataFrame) -> DataFrame:
    return agreement(confusion(compared, ["task_type"]), ["task_type"]).filter(F.col("n") >= MIN_TASK_LABELS)


def judge_diagnostics(joined: DataFrame) -> DataFrame:
    """One row of bias measures over labels joined with judgments."""
    judged = F.col("outcome").isNotNull()
    flips = F.count_if(judged & F.col("position_flip"))
    compared = F.col("status") == "compared"
    totals = joined.agg(
        F.count(F.lit(1)).alias("n_labelled"),
        F.count_if(compared).alias("n_compared"),
        F.count_if(F.col("status") == "unparseable").alias("n_unparseable"),
        F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.when(F.count_if(judged) > 0, flips / F.count_if(judged)).otherwise(0.0).alias("flip_rate"),
        F.count_if(F.col("candidate_shown_as") == "A").alias("shown_a"),
        F.count_if(F.col("candidate_shown_as") == "B").alias("shown_b"),
        *[F.count_if(compared & (F.col("human") == k)).alias(f"human_{k}") for k in stats.CLASSES],
        *[F.count_if(compared & (F.col("outcome") == k)).alias(f"judge_{k}") for k in stats.CLASSES],
    )
    # The median runs over distinct times with their counts.
    times = joined.filter(F.col("elapsed_ms") > 0).groupBy("elapsed_ms").agg(F.count(F.lit(1)).alias("_w"))
    median = times.agg(F.coalesce(F.percentile("elapsed_ms", F.lit(0.5), F.col("_w")).cast("bigint"), F.lit(0)).alias("median_elapsed_ms"))
    return totals.withColumn("_one", F.lit(1)).join(median.withColumn("_one", F.lit(1)), "_one").drop("_one")


def disagreement_profile(joined: DataFrame) -> DataFrame:
    """One row: direction of the disagreements, the task with most of them, fast labels."""
    wrong = joined.filter((F.col("status") == "compared") & (F.col("human") != F.col("outcome")))
    per_task = wrong.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "win").alias("toward_win"),
        F.count_if(F.col("outcome") == "loss").alias("toward_loss"),
        F.count_if((F.col("elapsed_ms") > 0) & (F.col("elapsed_ms") < FAST_LABEL_MS)).alias("fast"))
    return per_task.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("disagreements"),
        F.coalesce(F.sum("toward_win"), F.lit(0)).alias("toward_win"),
        F.coalesce(F.sum("toward_loss"), F.lit(0)).alias("toward_loss"),
        F.coalesce(F.sum("fast"), F.lit(0)).alias("fast"),
        F.max(F.struct("n", "task_type"))["task_type"].alias("top_task"),
        F.coalesce(F.max("n"), F.lit(0)).alias("top_task_n"))


def diagnose(agreed: DataFrame, diagnostics: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per finding that applies. ``agreed`` has the kappa interval; all inputs have one row."""
    one = F.lit(1).alias("_one")
    row = (agreed.select("*", one).join(diagnostics.select("*", one), "_one").join(profile.select("*", one), "_one"))
    recalls = F.array(*[F.struct(F.col(f"recall_{k}").alias("r"), F.lit(i).alias("i"), F.lit(k).alias("k"))
                        for i, k in enumerate(stats.CLASSES)])
    weakest = F.array_min(recalls)

    def many(x: str, y: str) -> Column:
        return F.col(x) > 2 * F.greatest(F.lit(1), F.col(y))

    rules = [
        ("gate_cleared", F.col("clears_gate"), F.col("kappa_ci_low")),
        ("gate_not_cleared", ~F.col("clears_gate"), F.col("kappa_ci_low")),
        ("tie_happy", many("judge_tie", "human_tie"), F.col("judge_tie")),
        ("over_deciding", many("human_tie", "judge_tie"), F.col("human_tie")),
        ("position_flips", F.col("flip_rate") > FLIP_LIMIT, F.col("flip_rate")),
        ("favours_candidate", many("toward_win", "toward_loss"), F.col("toward_win")),
        ("favours_reference", many("toward_loss", "toward_win"), F.col("toward_loss")),
        ("weak_class", weakest["r"] < WEAK_RECALL, weakest["r"]),
        ("one_task", (F.col("top_task_n") > F.col("disagreements") * ONE_TASK_SHARE), F.col("top_task_n")),
        ("fast_labels", F.col("fast") > F.greatest(F.lit(1), F.col("n")) * FAST_SHARE, F.col("fast")),
    ]
    subject = {"weak_class": weakest["k"], "one_task": F.col("top_task")}
    findings = F.array_compact(F.array(*[
        F.when(applies, F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("finding"),
                                 subject.get(name, F.lit(None).cast("string")).alias("subject"),
                                 value.cast("double").alias("value")))
        for i, (name, applies, value) in enumerate(rules)
    ]))
    return row.select(F.inline(findings))


def calibration_report(labels: DataFrame, judgments: DataFrame, ground_truth: DataFrame | None = None) -> DataFrame:
    """Headline row of a judge calibration: counts, kappa with its interval, bias measures, findings."""
    joined = join_labels_judgments(labels, judgments)
    agreed = kappa_ci(agreement(confusion(joined.filter(F.col("status") == "compared"))))
    diagnostics, profile = judge_diagnostics(joined), disagreement_profile(joined)
    findings = diagnose(agreed, diagnostics, profile).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "finding"))), lambda f: f["finding"]).alias("findings"))
    one = F.lit(1).alias("_one")
    out = agreed.select("*", one).join(diagnostics.select("*", one), "_one").join(findings.select("*", one), "_one")
    if ground_truth is not None:
        truth = judge_accuracy(ground_truth).select(
            F.col("n").alias("ground_truth_n"), F.col("accuracy").alias("ground_truth_accuracy"), one)
        out = out.join(truth, "_one")
    return out.drop("_one")
