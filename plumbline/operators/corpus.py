"""Building benchmark corpora: admission, de-duplication, sampling, splits, difficulty, fingerprint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.hashing import sha256, slot_for
from plumbline.operators.ranking import hash_rank

# ---- fixed values -------------------------------------------------------------------------
SPLITS = ("calibration", "dev", "test")
SPLIT_WEIGHTS = {"calibration": 0.20, "dev": 0.30, "test": 0.50}
TASK_VERIFIERS = {"math_word_problem": "final_number", "multiple_choice": "choice_letter"}
PLAIN_NUMBER = r"^-?\d[\d,]*(?:\.\d+)?$"
# -------------------------------------------------------------------------------------------


# ---- admission ----------------------------------------------------------------------------

def length_band(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def min_length(text: Column, chars: int) -> Column:
    return F.length(text) >= chars


def min_level(level: Column, lowest: int) -> Column:
    return F.coalesce(level.try_cast("int") >= lowest, F.lit(False))


def strip_tex_spacing(answer: Column) -> Column:
    return F.replace(F.replace(F.trim(answer), F.lit("\\!"), F.lit("")), F.lit("\\,"), F.lit(""))


def plain_number(answer: Column) -> Column:
    return answer.rlike(PLAIN_NUMBER)


def dedupe_first(df: DataFrame, text: Column, order: Sequence[str]) -> DataFrame:
    """First row per text in source order. Copies collapse inside each task before the shuffle,
    so a text with very many copies does not load one task."""
    row = F.struct(*df.columns)
    first = df.groupBy(sha256(text).alias("_h")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


# ---- sampling and splits ------------------------------------------------------------------

def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, seed: int, key: str) -> DataFrame:
    """``n div #strata`` rows (at least one) per stratum in seeded order, ``n`` in all at most."""
    ranked = hash_rank(df, strata, seed, key)
    sizes = df.groupBy(*strata).agg(F.lit(1).alias("_x")).agg(F.count(F.lit(1)).alias("_strata"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_strata")))
    picked = (
        ranked.filter(F.col("draw_rank") <= n)
        .withColumn("_one", F.lit(1)).join(sizes.withColumn("_one", F.lit(1)), "_one")
        .filter(F.col("draw_rank") <= quota).drop("_one", "_strata"))
    return picked.orderBy(*strata, "draw_rank").limit(n)


def label_pairs(items: DataFrame, models: Sequence[str], reference: str, n: int, seed: int) -> DataFrame:
    """Comparisons for people to label: equal cells of task x model, a seeded shuffle, n at most."""
    from plumbline.operators.costing import build_tasks

    cells = build_tasks(items.select("slug", "task_type"), models).select(
        "slug", "task_type", F.col("model").alias("candidate_model"),
        F.concat("slug", F.lit("|"), "model").alias("pair_id"))
    drawn = stratified_sample(cells, ["task_type", "candidate_model"], n, seed, "slug")
    shuffled = drawn.withColumn("_u", F.md5(F.concat_ws("|", F.lit(f"{seed}:pairs"), F.col("pair_id"))))
    return shuffled.orderBy("_u", "pair_id").limit(n).select(
        "pair_id", "slug", "task_type", "candidate_model", F.lit(reference).alias("reference_model"),
        slot_for(seed, F.col("slug"), F.col("candidate_model")).alias("candidate_shown_as"))


def split_of(rank: Column, size: Column, weights: Mapping[str, float] = SPLIT_WEIGHTS) -> Column:
    """Split by rank: exact sizes, floor(n*w), the remainder one each from the first split on."""
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError(f"the shares of the splits add up to {sum(weights.values())} instead of one")
    floors = [F.floor(size * F.lit(float(weights[s]))) for s in SPLITS]
    rest = size - sum(floors[1:], floors[0])
    label, upto = None, F.lit(0)
    for i, name in enumerate(SPLITS[:-1]):
        upto = upto + floors[i] + F.when(rest > i, 1).otherwise(0)
        label = (F if label is None else label).when(rank <= upto, F.lit(name))
    return label.otherwise(F.lit(SPLITS[-1]))


def assign_splits(df: DataFrame, strata: Sequence[str], seed: int, key: str,
                  weights: Mapping[str, float] = SPLIT_WEIGHTS) -> DataFrame:
    ranked = hash_rank(df, strata, seed, key, "_rank", "_size")
    return ranked.withColumn("split", split_of(F.col("_rank"), F.col("_size"), weights)).drop("_rank", "_size")


def build_corpus(raw: DataFrame, targets: Mapping[str, int], seed: int,
                 weights: Mapping[str, float] = SPLIT_WEIGHTS) -> DataFrame:
    """Exactly ``targets[task]`` items per task with slugs and splits.

    A pool that is short or empty and equal prompts (``prompt`` or ``text``) among the chosen items are errors.
    Each task draws from its own hash order, so a new task leaves the others as they were.
    """
    _require_pools(raw, targets)
    want = None
    for task, n in targets.items():
        want = (F if want is None else want).when(F.col("task_type") == task, F.lit(n))
    pool = raw.withColumn("_key", F.concat_ws("|", "source_dataset", "source_id")).withColumn("_want", want)
    ranked = hash_rank(pool.filter(F.col("_want").isNotNull()), ["task_type"], seed, "_key")
    short = F.concat(F.lit("too few candidates for task "), F.col("task_type"))
    enough = ranked.withColumn("_want", F.when(F.col("stratum_size") >= F.col("_want"), F.col("_want"))
                               .otherwise(F.raise_error(short).cast("int")))
    chosen = enough.filter(F.col("draw_rank") <= F.col("_want")).withColumn(
        "slug", F.format_string("%s-%04d", F.col("task_type"), F.col("draw_rank") - 1))
    _require_distinct_prompts(chosen)
    split = assign_splits(chosen, ["task_type"], seed + 1, "_key", weights)
    verifier = None
    for task, name in TASK_VERIFIERS.items():
        verifier = (F if verifier is None else verifier).when(F.col("task_type") == task, F.lit(name))
    verifiable = F.col("ground_truth").isNotNull()
    return split.withColumn("verifiable", verifiable).withColumn("verifier", F.when(verifiable, verifier)).drop(
        "_key", "_want", "draw_rank", "stratum_size")


def _require_pools(raw: DataFrame, targets: Mapping[str, int]) -> None:
    wanted = [t for t, n in targets.items() if n > 0]
    met = {r["task_type"] for r in raw.filter(F.col("task_type").isin(wanted)).select("task_type").distinct().collect()}
    if missing := sorted(set(wanted) - met):
        raise ValueError(f"no candidate at all for {missing}")


def _require_distinct_prompts(chosen: DataFrame) -> None:
    column = next((c for c in ("prompt", "text") if c in chosen.columns), None)
    if column is None:
        return
    digest = sha256(F.col(column))
    copies = chosen.filter(F.col(column).isNotNull()).groupBy(digest.alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.min("slug").alias("slug"))
    if found := copies.filter("n > 1").orderBy("slug").limit(5).collect():
        raise ValueError(f"equal prompts among the chosen items, e.g. {[(r['slug'], r['n']) for r in found]}")


def corpus_profile(items: DataFrame) -> DataFrame:
    """Item counts by task, by split and in all, with the gradable ones."""
    sets = items.groupingSets([["task_type"], ["split"], []], "task_type", "split")
    return sets.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("ground_truth").isNotNull()).alias("gradable"))


# ---- difficulty ---------------------------------------------------------------------------

def pass_rates(pilot: DataFrame) -> DataFrame:
    """Pass rate by model and by model and task (task NULL for the model's total)."""
    sets = pilot.groupingSets([["model"], ["model", "task_type"]], "model", "task_type")
    n, k = F.count(F.lit(1)), F.count_if("passed")
    return sets.agg(n.alias("n"), k.alias("passes"), (k / n).alias("pass_rate"))


def outcomes_per_item(pilot: DataFrame) -> DataFrame:
    return pilot.groupBy("slug").agg(
        F.count(F.lit(1)).alias("results"), F.bool_and("passed").alias("all_passed"),
        F.bool_or("passed").alias("any_passed"), F.max("task_type").alias("task_type"))


def item_outcomes(pilot: DataFrame) -> DataFrame:
    per_item = outcomes_per_item(pilot)
    return per_item.agg(
        F.count_if("all_passed").alias("all_models_passed"),
        F.count_if(~F.col("all_passed") & F.col("any_passed")).alias("models_disagreed"),
        F.count_if(~F.col("any_passed")).alias("all_models_failed"))


def discriminative(mode: str = "discriminative", min_models: int = 2) -> Column:
    """Over ``outcomes_per_item``: keep items that not every model passed (and, by mode, some did)."""
    keep = (F.col("results") >= min_models) & ~F.col("all_passed")
    if mode == "discriminative":
        return keep & F.col("any_passed")
    if mode == "drop_easy":
        return keep
    raise ValueError(f"unknown mode {mode!r}")


def discriminative_items(pilot: DataFrame, min_models: int = 2, mode: str = "discriminative") -> DataFrame:
    return outcomes_per_item(pilot).filter(discriminative(mode, min_models)).select("slug", "task_type")


def filter_by_difficulty(items: DataFrame, pilot: DataFrame, min_models: int = 2, mode: str = "discriminative") -> DataFrame:
    """Items that stay: free-form ones, ones outside the pilot, and discriminative ones."""
    judged = outcomes_per_item(pilot).select("slug", discriminative(mode, min_models).alias("_keep"))
    joined = items.join(judged, "slug", "left")
    stays = F.col("ground_truth").isNull() | F.coalesce(F.col("_keep"), F.lit(True))
    return joined.filter(stays).drop("_keep")


def difficulty_report(pilot: DataFrame, min_models: int = 2, mode: str = "discriminative") -> DataFrame:
    """Piloted, kept and removed items per task."""
    per_item = outcomes_per_item(pilot).withColumn("_keep", discriminative(mode, min_models))
    kept = F.count_if("_keep")
    return per_item.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("piloted"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("removed"))


# ---- identity -----------------------------------------------------------------------------

def row_digest(*columns: str) -> Column:
    """sha256 of the row as JSON with its fields in order, nulls included."""
    return sha256(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def fingerprint(df: DataFrame, columns: Sequence[str], levels: Sequence[int] = (6, 3, 0)) -> DataFrame:
    """Order-independent content hash of a table, as a tree over row digests.

    Digests are grouped by ever shorter prefixes; a node hashes its sorted children. No node
    gathers more than its share of the digests, whatever the size of the table. Equal rows are
    counted, not gathered.
    """
    digest = row_digest(*columns)
    copies = df.groupBy(digest.alias("_d")).agg(F.count(F.lit(1)).alias("_copies"))
    node = copies.select(F.col("_d").alias("_at"), sha256(F.concat_ws("x", "_d", "_copies")).alias("_hash"),
                         F.col("_copies").alias("_rows"))
    for prefix in levels:
        children = F.array_sort(F.collect_list(F.struct("_at", "_hash")))
        node = node.groupBy(F.substring("_at", 1, prefix).alias("_p")).agg(
            sha256(F.array_join(F.transform(children, lambda c: c["_hash"]), "")).alias("_hash"),
            F.sum("_rows").alias("_rows"),
        ).withColumnRenamed("_p", "_at")
    return node.select(F.col("_hash").alias("fingerprint"), F.col("_rows").alias("rows"))
