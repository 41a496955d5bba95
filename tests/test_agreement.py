"""Judge agreement: kappa, gates, findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import agreement as ag


def rated(spark, pairs):
    return spark.createDataFrame(pairs, "human string, outcome string")


def kappa(spark, pairs):
    return ag.agreement(ag.confusion(rated(spark, pairs))).first()


def test_perfect(spark):
    row = kappa(spark, [(k, k) for k in stats.CLASSES] * 10)
    assert row["kappa"] == 1.0 and row["raw_agreement"] == 1.0


def test_always_tie(spark):
    row = kappa(spark, [(k, "tie") for k in stats.CLASSES] * 10)
    assert row["kappa"] == 0.0 and row["raw_agreement"] == pytest.approx(1 / 3)


def test_swapped_is_worse_than_chance(spark):
    assert kappa(spark, [("win", "loss"), ("loss", "win")] * 5)["kappa"] < 0


def test_single_class(spark):
    assert kappa(spark, [("win", "win")] * 9)["kappa"] == 0.0


def test_nothing_compared(spark):
    row = kappa(spark, [])
    assert row["n"] == 0 and row["kappa"] == 0.0 and row["raw_agreement"] == 0.0


def test_interval_is_seeded_and_matches_resampling(spark):
    pairs = [("win", "win")] * 30 + [("tie", "tie")] * 20 + [("loss", "loss")] * 25 + [("win", "tie")] * 6 + [("loss", "win")] * 4
    cells = ag.agreement(ag.confusion(rated(spark, pairs)))
    a, b = ag.kappa_ci(cells).first(), ag.kappa_ci(cells.repartition(5)).first()
    assert (a["kappa_ci_low"], a["kappa_ci_high"]) == (b["kappa_ci_low"], b["kappa_ci_high"])
    assert a["kappa_ci_low"] < a["kappa"] < a["kappa_ci_high"]
    rng = np.random.default_rng(0)
    index = {k: i for i, k in enumerate(stats.CLASSES)}
    data = np.array([3 * index[h] + index[j] for h, j in pairs])
    draws = np.array([np.bincount(rng.choice(data, len(data)), minlength=9) for _ in range(4000)])
    low, high = np.percentile(stats._kappa_of(draws), [2.5, 97.5])
    assert a["kappa_ci_low"] == pytest.approx(low, abs=0.02) and a["kappa_ci_high"] == pytest.approx(high, abs=0.02)


def test_gate_is_on_the_lower_bound(spark):
    few = [(k, k) for k in stats.CLASSES] * 4 + [("win", "loss")] * 2
    row = ag.kappa_ci(ag.agreement(ag.confusion(rated(spark, few)))).first()
    assert row["kappa"] > 0.6 and not row["clears_gate"]


def test_thin_tasks_are_left_out(spark):
    df = spark.createDataFrame([("a", "win", "win")] * 5 + [("b", "win", "win")] * 4, "task_type string, human string, outcome string")
    assert [r["task_type"] for r in ag.agreement_by_task(df).collect()] == ["a"]


def test_statuses_and_findings(spark):
    labels = spark.createDataFrame(
        [(f"p{i}", "qa", "win" if i % 2 else "loss", 1000, "A") for i in range(40)] + [("lost", "qa", "win", 9000, "B"), ("odd", "qa", "tie", 9000, "B")],
        "pair_id string, task_type string, human string, elapsed_ms bigint, candidate_shown_as string")
    judged = spark.createDataFrame(
        [(f"p{i}", "tie" if i < 30 else ("win" if i % 2 else "loss"), False, i % 3 == 0) for i in range(40)] + [("odd", None, True, False)],
        "pair_id string, outcome string, unparseable boolean, position_flip boolean")
    joined = ag.join_labels_judgments(labels, judged)
    assert {r["status"]: r["count"] for r in joined.groupBy("status").count().collect()} == {"compared": 40, "missing": 1, "unparseable": 1}
    report = ag.calibration_report(labels, judged).first()
    assert report["n_labelled"] == 42 and report["n_compared"] == 40 and report["median_elapsed_ms"] == 1000
    assert report["findings"] == ["gate_not_cleared", "tie_happy", "position_flips", "weak_class", "one_task", "fast_labels"]


def test_reply_log_excludes_unreadable_positions(spark):
    rows = [("p", "A", '{"outcome":"A"}'), ("p", "B", '{"outcome":"B","confidence":0.8}'), ("q", "A", '{"outcome":"A"}'), ("q", "B", '{"outcome":"A"}'), ("r", "A", "?"), ("r", "B", '{"outcome":"B"}')]
    got = {r["pair_id"]: r for r in ag.score_judge_log(spark.createDataFrame(rows, "pair_id string, position string, raw string")).collect()}
    assert got["p"]["outcome"] == "win" and got["p"]["confidence"] == 0.65 and not got["p"]["position_flip"]
    assert got["q"]["outcome"] == "tie" and got["q"]["position_flip"]
    assert got["r"]["outcome"] is None and got["r"]["unparseable"]


def test_ground_truth_limit_takes_the_first(spark):
    rows = [(f"s{i}", "m", "ref", f"#### {i}", "#### 99", "final_number", str(i)) for i in range(9, -1, -1)]
    df = spark.createDataFrame(rows, "slug string, candidate_model string, reference_model string, candidate_text string, reference_text string, verifier string, ground_truth string")
    assert [r["slug"] for r in ag.ground_truth_discriminable(df, 3).collect()] == ["s0", "s1", "s2"]
    assert ag.judge_accuracy(df.withColumn("expected", F.lit("win")).withColumn("outcome", F.lit("win"))).first()["accuracy"] == 1.0
