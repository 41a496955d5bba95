"""Validation rules as columns: every rule names what it found, nothing is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.hashing import sha256
from plumbline.functions.text import SYSTEM_ROLES

# ---- fixed values -------------------------------------------------------------------------
DOC_FILENAMES = ("readme.md", "contributing.md", "changelog.md", ".gitkeep")
PROMPT_PREFIX = "prompts/"
MAX_STOPS = 4
MAX_TEMPERATURE = 2.0
# -------------------------------------------------------------------------------------------


def check_item_invariants(items: DataFrame) -> DataFrame:
    """Violations per rule: ground truth only with verifiable items, unique slugs, unique prompts."""
    has_both = F.col("ground_truth").isNotNull() & F.col("verifier").isNotNull()
    has_any = F.col("ground_truth").isNotNull() | F.col("verifier").isNotNull()
    row = items.agg(
        F.count_if(F.col("verifiable") & ~has_both).alias("verifiable_without_truth"),
        F.count_if(~F.col("verifiable") & has_any).alias("truth_without_verifiable"))
    names = ["verifiable_without_truth", "truth_without_verifiable"]
    rows = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names])))

    def repeats(value: Column, rule: str) -> DataFrame:
        return items.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.lit(rule).alias("rule"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"))

    return rows.unionByName(repeats(F.col("slug"), "repeated_slug")).unionByName(
        repeats(sha256(F.col("prompt")), "repeated_prompt"))


def audit_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``failed_rules``: the names of the rules a request breaks, in a fixed order."""
    def outside(column: str, ok: Column) -> Column:
        return F.col(column).isNotNull() & ~ok

    rules = [
        ("model", F.coalesce(F.length("model"), F.lit(0)) == 0),
        ("messages", F.coalesce(F.array_size("messages"), F.lit(0)) == 0),
        ("non_system_message", (F.size("messages") > 0) & ~F.exists("messages", lambda m: ~m["role"].isin(*SYSTEM_ROLES))),
        ("n", outside("n", F.col("n") == 1)),
        ("temperature", outside("temperature", F.col("temperature").between(0.0, MAX_TEMPERATURE))),
        ("top_p", outside("top_p", (F.col("top_p") > 0.0) & (F.col("top_p") <= 1.0))),
        ("stop", outside("stop", F.size("stop") <= MAX_STOPS)),
        ("max_tokens", outside("max_tokens", F.col("max_tokens") > 0)),
        *([("max_completion_tokens", outside("max_completion_tokens", F.col("max_completion_tokens") > 0))]
          if "max_completion_tokens" in requests.columns else []),
    ]
    failed = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return requests.withColumn("failed_rules", failed)


def parameter_compat(requests: DataFrame, catalog: DataFrame, default_max_output: int) -> DataFrame:
    """What a target model does with sampling parameters, and the output cap that applies."""
    limits = catalog.select("model", F.col("max_output_tokens").alias("_max"), F.col("supports_sampling_params").alias("_takes"))
    joined = requests.join(limits, "model", "left")
    given = F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.lit(p)) for p in ("temperature", "top_p")]))
    refused = ~F.col("_takes") & (F.size(given) > 0)
    cap = F.coalesce("max_completion_tokens", "max_tokens", F.lit(default_max_output))
    return joined.select(
        *requests.columns,
        F.when(refused & F.col("pinned"), F.get(given, F.lit(0))).alias("rejected_param"),
        F.when(refused & ~F.col("pinned"), given).otherwise(F.array().cast("array<string>")).alias("dropped_params"),
        F.least(cap, F.col("_max")).alias("output_cap"))


def touches_prompts(changes: DataFrame, prefix: str = PROMPT_PREFIX) -> DataFrame:
    """Per pull request: does any changed file lie under the prefix and is not documentation?"""
    basename = F.lower(F.substring_index("filename", "/", -1))
    hit = F.col("filename").startswith(prefix) & ~basename.isin(*DOC_FILENAMES)
    return changes.groupBy("pr").agg(F.count(F.lit(1)).alias("files"), F.bool_or(hit).alias("touches_prompts"))


def cost_change(summaries: DataFrame) -> DataFrame:
    """Cost delta and percent between two arms; no percent from a zero baseline."""
    delta = F.col("candidate_nano") - F.col("baseline_nano")
    return summaries.withColumn("cost_delta_nano", delta).withColumn(
        "cost_change_pct", F.when(F.col("baseline_nano") > 0, delta / F.col("baseline_nano") * 100))
