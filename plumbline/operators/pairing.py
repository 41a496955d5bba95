"""Pairing arms item by item, and attaching statistics to every pair in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import answers, stats
from plumbline.operators.ranking import join_null_safe
from plumbline.session import stored


def grade_generations(items: DataFrame, gens: DataFrame) -> DataFrame:
    """Generation rows with their item's task and a pass flag; ungradable rows stay, ungraded."""
    keys = items.select("slug", "task_type", "split", "verifier", "ground_truth")
    joined = gens.join(keys, "slug")
    passed = answers.verify(F.col("verifier"), F.col("text"), F.col("ground_truth"))
    return joined.withColumn("passed", passed).drop("verifier", "ground_truth")


def pair_arms(scored: DataFrame, pairs: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """(slug, comparison, a, b) for every listed pair of models that both scored the item.

    All arms of an item meet in one aggregation, so k pairs cost one shuffle and no self-join.
    """
    arms = sorted({m for pair in pairs for m in pair})
    scores = [F.max(F.when(F.col("model") == m, F.col("success"))).alias(f"_s{i}") for i, m in enumerate(arms)]
    wide = scored.filter(F.col("model").isin(*arms)).groupBy("slug", *keep).agg(*scores)
    at = {m: F.col(f"_s{i}") for i, m in enumerate(arms)}
    rows = F.array(*[
        F.struct(F.lit(f"{a}->{b}").alias("comparison"), F.lit(a).alias("baseline"), F.lit(b).alias("candidate"),
                 at[a].alias("a"), at[b].alias("b"))
        for a, b in pairs
    ])
    return wide.select("slug", *keep, F.inline(rows))


def contingency(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """The 2x2 table per comparison, and how many items lack one side."""
    a, b = F.col("a"), F.col("b")
    return paired.groupBy(*by).agg(
        F.count_if(~a & ~b).alias("n00"), F.count_if(~a & b).alias("b"),
        F.count_if(a & ~b).alias("c"), F.count_if(a & b).alias("n11"),
        F.count_if(a.isNull() | b.isNull()).alias("missing"),
    ).withColumn("n", F.col("n00") + F.col("b") + F.col("c") + F.col("n11"))


def compare(counts: DataFrame, margin: float = stats.MARGIN, alpha: float = stats.ALPHA,
            resamples: int = stats.RESAMPLES) -> DataFrame:
    """Effect, interval, test and outcome for each row of counts (n00, b, c, n11, n)."""
    n, b, c = F.col("n"), F.col("b"), F.col("c")
    bounded = counts.withColumn("_ci", stats.paired_interval(n, b, c, alpha, resamples))
    low, high = F.col("_ci.low") / n, F.col("_ci.high") / n
    half = F.bround((F.bround(high, 6) - F.bround(low, 6)) / 2.0, 6)
    return bounded.select(
        *counts.columns,
        ((b - c) / n).alias("effect"), low.alias("ci_low"), high.alias("ci_high"),
        stats.classify_interval(F.bround(low, 6), F.bround(high, 6), margin).alias("outcome"),
        ((F.col("_ci.low") > 0) | (F.col("_ci.high") < 0)).alias("significant"),
        half.alias("detectable_effect"), (half <= margin).alias("can_show_equivalence"),
        F.round(stats.mcnemar_p(b, c), 8).alias("mcnemar_p"), stats.mcnemar_method(b, c).alias("mcnemar_method"),
        (b + c).alias("n_discordant"), (F.col("n00") + F.col("n11")).alias("n_concordant"),
        ((F.col("c") + F.col("n11")) / n).alias("baseline_rate"),
        ((F.col("b") + F.col("n11")) / n).alias("candidate_rate"),
    )


def compare_runs(scored: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = (),
                 margin: float = stats.MARGIN, alpha: float = stats.ALPHA,
                 resamples: int = stats.RESAMPLES) -> DataFrame:
    """One row per (by, pair of arms) with counts, interval, test and outcome."""
    keys = [*by, "comparison", "baseline", "candidate"]
    counts = contingency(pair_arms(scored, pairs, by), keys).filter("n > 0")
    return compare(counts, margin, alpha, resamples)


def bh_qvalues(tests: DataFrame, family: Sequence[str], p: str = "p_value", slices: int = 64) -> DataFrame:
    """Benjamini-Hochberg q-values; tests are already aggregated, one row each.

    A row without a p-value is no test: it has no q-value and does not count in its family. Equal
    p-values have equal q-values, so only distinct ones are ranked, with their counts. They are cut
    into ranges at approximate quantiles; each range is ordered in a task of its own, and the count
    of the ranges below and the least ratio of the ranges above are carried in.
    """
    value, keys = F.col(p), list(family)
    checked = stored(tests.withColumn(
        p, F.when(value.between(0.0, 1.0) | value.isNull(), value)
        .otherwise(F.raise_error(F.lit("a p-value lies outside 0 to 1")).cast("double"))
    ), "tests")
    distinct = checked.filter(value.isNotNull()).groupBy(*keys, value.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    fractions = F.array(*[F.lit((i + 1) / slices) for i in range(slices - 1)])
    cuts = distinct.groupBy(*keys).agg(
        F.sum("_n").alias("family_size"),
        (F.percentile_approx("_p", fractions, 100 * slices) if slices > 1 else F.array().cast("array<double>")).alias("_cuts"))
    ranged = join_null_safe(distinct, cuts, keys).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_p")))).drop("_cuts")

    def carried(parts: DataFrame, amount: Column, name: str, order: Column) -> DataFrame:
        """Each range with what the ranges before it bring: at most ``slices`` rows of a family."""
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return parts.select(*keys, "_slice", amount.over(before).alias(name))

    inside = Window.partitionBy(*keys, "_slice")
    below = carried(ranged.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_n")), F.sum("_n"), "_below", F.col("_slice"))
    upto = F.sum("_n").over(inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ratios = join_null_safe(ranged, below, [*keys, "_slice"]).withColumn(
        "_ratio", F.col("_p") * F.col("family_size") / (upto + F.coalesce("_below", F.lit(0))))
    above = carried(ratios.groupBy(*keys, "_slice").agg(F.min("_ratio").alias("_least")), F.min("_least"), "_above", F.col("_slice").desc())
    least = F.min("_ratio").over(inside.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = join_null_safe(ratios, above, [*keys, "_slice"]).select(
        *keys, F.col("_p").alias(p), F.round(F.least(F.lit(1.0), least, "_above"), 8).alias("q_value"))
    sized = join_null_safe(checked, cuts.drop("_cuts"), keys, "left").withColumn("family_size", F.coalesce("family_size", F.lit(0)))
    return join_null_safe(sized, found, [*keys, p], "left")

def poisson_bootstrap(scores: DataFrame, by: Sequence[str], key: str, value: str, seed: int, replicates: int,
                      alpha: float = stats.ALPHA) -> DataFrame:
    """Percentile interval of a mean of integer-valued scores, for arms that are not just pass/fail.

    Item i enters replicate r with a Poisson(1) weight read off a hash of (seed, i, r). Sums are
    integers, so partitioning cannot change them. One md5 serves four replicates.
    """
    blocks = -(-replicates // 4)
    spread = scores.select(*by, key, F.col(value).cast("bigint").alias("_v"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("_block").cast("string")))
    spread = spread.withColumn("_digest", digest)
    weighted = spread
    for lane in range(4):
        u = F.conv(F.substring("_digest", 1 + 8 * lane, 8), 16, 10).cast("bigint")
        weighted = weighted.withColumn(f"_w{lane}", poisson_weight(u))
    sums = weighted.groupBy(*by, "_block").agg(
        *[F.sum(f"_w{i}").alias(f"_n{i}") for i in range(4)],
        *[F.sum(F.col(f"_w{i}") * F.col("_v")).alias(f"_s{i}") for i in range(4)],
    )
    lanes = F.array(*[F.struct((F.col("_block") * 4 + i).alias("replicate"), F.col(f"_n{i}").alias("n"),
                               F.col(f"_s{i}").alias("s")) for i in range(4)])
    draws = sums.select(*by, F.inline(lanes)).filter(F.col("replicate") < replicates)
    means = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("s") / F.col("n"))))
    low_at, high_at = int((alpha / 2) * replicates), min(replicates - 1, int((1 - alpha / 2) * replicates))
    interval = draws.groupBy(*by).agg(means.alias("_m")).select(
        *by, F.get("_m", F.lit(low_at)).alias("ci_low"), F.get("_m", F.lit(high_at)).alias("ci_high"))
    point = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("bigint")).alias("total"))
    return point.join(interval, list(by)).select(
        *by, "n", (F.col("total") / F.col("n")).alias("mean"), "ci_low", "ci_high")


# Cumulative Poisson(1) probabilities on the 32-bit scale, from the definition, until the scale is exhausted.
def _poisson_cuts() -> list[int]:
    import math
    cuts, total, k = [], 0.0, 0
    while not cuts or cuts[-1] < 4294967295:
        total += math.exp(-1.0) / math.factorial(k)
        cuts.append(int(total * 4294967296.0))
        k += 1
    return cuts


POISSON_CUTS = _poisson_cuts()


def poisson_weight(u: Column) -> Column:
    """Poisson(1) quantile of a 32-bit uniform: how many cuts lie at or below it."""
    weight = F.lit(0)
    for cut in POISSON_CUTS:
        weight = weight + (u >= F.lit(cut)).cast("int")
    return weight


def required_items_per_comparison(counts: DataFrame, effect: float) -> DataFrame:
    """Per comparison: items needed to see ``effect``, given the discordant rate it measured."""
    rate = (F.col("b") + F.col("c")) / F.col("n")
    return counts.withColumn("discordant_rate", rate).withColumn(
        "required_items", stats.required_items(F.lit(effect), F.col("discordant_rate")))


