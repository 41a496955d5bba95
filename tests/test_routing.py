"""Records, cascades, sweeps, policies, routed requests."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import uniform
from plumbline.operators import costing, pairing, routing
from plumbline.plans import fixtures as fx

RECORD = "slug string, task_type string, split string, model string, success boolean, cost_nano bigint, agreement double, verifier_confidence double"
COSTS = {"cheap": 170, "mid": 3000, "strong": 13750}


def records(spark, items):
    """items: (slug, task, split, {model: success}, confidence)"""
    rows = [(s, t, sp, m, ok, COSTS[m], conf, conf) for s, t, sp, arms, conf in items for m, ok in arms.items()]
    return spark.createDataFrame(rows, RECORD)


def world(n, seed=0, task="math_word_problem", split="dev", cheap=0.7, strong=0.95):
    rng = random.Random(seed)
    return [(f"{split}-{task}-{i}", task, split, {"cheap": rng.random() < cheap, "strong": rng.random() < strong}, round(rng.randrange(6) / 5, 2)) for i in range(n)]


def brute_sweep(items, threshold, k=3, check=1250):
    n = ok = cost = up = 0
    for _, task, _, arms, conf in items:
        n += 1
        spent = COSTS["cheap"] * k if task in routing.GRADABLE_TASKS else COSTS["cheap"] + check
        escalate = conf < threshold
        ok += arms["strong"] if escalate else arms["cheap"]
        cost += spent + (COSTS["strong"] if escalate else 0)
        up += escalate
    return n, ok, cost, up


def test_sweep_matches_one_pass_per_threshold(spark):
    items = world(150, 1) + world(100, 2, "summarization")
    inputs = routing.cascade_inputs(records(spark, items), "cheap", "strong", 3, 1250)
    got = {r["threshold"]: (r["n"], r["served_ok"], r["cost_nano"], r["escalated"]) for r in routing.cascade_outcomes(inputs).collect()}
    assert got == {t: brute_sweep(items, t) for t in routing.SWEEP_GRID}
    ups = [got[t][3] for t in sorted(got)]
    assert ups == sorted(ups) and ups[0] == 0


def test_check_costs(spark):
    one = [("a", "math_word_problem", "dev", {"cheap": True, "strong": True}, 0.0), ("b", "support_reply", "dev", {"cheap": True, "strong": True}, 0.0)]
    rows = {r["slug"]: r["check_nano"] for r in routing.cascade_inputs(records(spark, one), "cheap", "strong", 3, 1250).collect()}
    assert rows == {"a": 510, "b": 1420}
    always = routing.sweep(routing.cascade_inputs(records(spark, one), "cheap", "strong", 3, 1250)).filter("threshold = 1.0").first()
    assert always["cost_ratio"] > 1.0


def test_missing_confidence_is_an_error(spark):
    bad = records(spark, [("a", "math_word_problem", "dev", {"cheap": True, "strong": True}, None)])
    with pytest.raises(Exception, match="no confidence"):
        routing.cascade_inputs(bad, "cheap", "strong").collect()


def test_small_samples_choose_nothing(spark):
    sure = [(slug, task, split, arms, 1.0) for slug, task, split, arms, _ in world(14, 3)]  # nothing ever escalates
    got = routing.operating_point(routing.sweep(routing.cascade_inputs(records(spark, sure), "cheap", "strong"))).first()
    assert got["threshold"] is None and got["eligible_points"] == 0


def test_frontier_and_choice(spark):
    points = spark.createDataFrame(
        [("dev", 0.1, 10.0, 0.5, True, 0.1), ("dev", 0.2, 10.0, 0.6, True, 0.1), ("dev", 0.3, 12.0, 0.6, True, 0.1), ("dev", 0.4, 20.0, 0.9, False, 0.2)],
        "split string, threshold double, mean_cost_nano double, quality double, eligible boolean, cost_ratio double")
    assert [r["threshold"] for r in routing.pareto_frontier(points).orderBy("threshold").collect()] == [0.2, 0.4]
    assert routing.operating_point(points).first()["threshold"] == 0.2


def arms(n, k, task, model="cheap"):
    return [(f"{task}-{i}", task, "dev", model, i < k, 1, 1.0, 1.0) for i in range(n)]


def fitted(spark, rows, floor=0.9):
    df = spark.createDataFrame(rows, RECORD)
    return {r["route_key"]: r for r in routing.fit_offline_policy(df, ["cheap", "strong"], "strong", floor).collect()}


def test_policy_rules(spark):
    rows = arms(120, 120, "sure") + arms(30, 27, "border") + arms(5, 5, "thin") + arms(5, 5, "thin", "strong") + arms(30, 30, "border", "strong")
    got = fitted(spark, rows)
    assert got["sure"]["assigned_model"] == "cheap" and got["border"]["assigned_model"] == "strong" and got["border"]["quality"] == 1.0
    assert got["thin"]["assigned_model"] == "strong" and (got["thin"]["reason"], got["thin"]["n_items"]) == ("thin", 5) and got["thin"]["quality"] == 0.0
    nothing = fitted(spark, arms(40, 10, "bad") + arms(40, 20, "bad", "strong"))["bad"]
    assert nothing["assigned_model"] == "strong" and nothing["quality"] == 0.0 and nothing["reason"] == "none_cleared"


def test_route_size_counts_items_without_the_model(spark):
    rows = arms(20, 20, "r") + [(f"x{i}", "r", "dev", "strong", True, 1, 1.0, 1.0) for i in range(20)]
    assert fitted(spark, rows)["r"]["n_items"] == 40


def test_leak_guard(spark):
    fit = spark.createDataFrame([(f"s{i}",) for i in range(10)], "slug string")
    report = spark.createDataFrame([(f"s{i}",) for i in range(8, 20)], "slug string")
    row = routing.assert_disjoint(fit, report).first()
    assert row["overlap"] == 2 and row["examples"] == ["s8", "s9"] and row["leak"]
    with pytest.raises(ValueError, match="2 item"):
        routing.require_disjoint(fit, report)
    routing.require_disjoint(fit, report.filter("slug >= 's90'"))


def test_choice_is_made_on_one_split_and_read_on_the_other(spark):
    items = world(900, 4, cheap=0.9, strong=0.9) + world(900, 5, split="test", cheap=0.9, strong=0.9)
    row = routing.fit_and_report(records(spark, items), "cheap", "strong", ["cheap", "strong"], "strong", 0.85, margin=0.08).first()
    assert row["chosen_threshold"] is not None and row["refusal"] is None and row["held_out_n"] == 900
    n, ok, cost, _ = brute_sweep([i for i in items if i[2] == "test"], row["chosen_threshold"], check=0)
    assert row["held_out_quality"] == ok / n and row["held_out_cost_ratio"] == cost / (COSTS["strong"] * n)


def test_an_item_in_both_splits_is_refused(spark):
    items = world(40, 1) + [(world(40, 1)[0][0], "math_word_problem", "test", {"cheap": True, "strong": True}, 1.0)]
    with pytest.raises(ValueError, match="more than one split"):
        routing.fit_and_report(records(spark, items), "cheap", "strong", ["cheap", "strong"], "strong", 0.9)


def test_routing_reasons(spark):
    policy = spark.createDataFrame([("math", "cheap")], "route_key string, assigned_model string")
    cases = [("m1", "math", None, "explicit_model", "m1", None), ("auto", " math ", None, "policy_route", "cheap", "math"), ("auto", "math", " OFF", "router_off", "strong", None),
             ("auto", "art", None, "unknown_route", "strong", "art"), ("auto", "  ", None, "no_route_hint", "strong", None), ("auto", None, "bogus", "no_route_hint", "strong", None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, model string, route_hint string, mode_header string")
    for r in routing.route_traffic(df, policy, "offline", "fallback", "strong").collect():
        assert (r["reason"], r["model_served"], r["route_key"]) == cases[r["i"]][3:]
    none = routing.route_traffic(df, None, "offline", "fallback").filter("i = 1").first()
    assert (none["reason"], none["model_served"]) == ("no_policy", "fallback")


def gens(spark, rows):
    return spark.createDataFrame(rows, "slug string, model string, replicate_idx int, text string, input_tokens bigint, output_tokens bigint, verifier string").withColumn("ground_truth", F.lit("1"))


def test_self_consistency(spark):
    rows = [("a", "m", i, t, 1, 1, "final_number") for i, t in enumerate(["#### 1", "is 1", "#### 2", "?", "none"])]
    rows += [("b", "m", 0, "?", 1, 1, "final_number"), ("b", "m", 1, "!", 1, 1, "final_number")]
    rows += [("gap", "m", i, "#### 1", 1, 1, "final_number") for i in (0, 1, 3, 4)] + [("late", "m", 1, "#### 1", 1, 1, "final_number")]
    rows += [("many", "m", i, "#### 1" if i % 3 else f"#### {i + 5}", 1, 1, "final_number") for i in range(12)]
    got = {r["slug"]: (r["samples"], r["agreement"]) for r in costing.samples_per_item(gens(spark, rows * 2)).collect()}
    assert got == {"a": (5, 0.4), "b": (2, 0.5), "gap": (2, 1.0), "late": (0, None), "many": (12, 8 / 12)}
    used = {r["slug"]: r["samples"] for r in costing.contiguous_replicates(gens(spark, rows * 2)).collect()}
    assert used == {k: v[0] for k, v in got.items()}


def test_records_skip_reasons(spark):
    items = spark.createDataFrame(
        [("ok", "t", "dev", "final_number", "1"), ("free", "t", "dev", None, None), ("half", "t", "dev", "final_number", "1"), ("single", "t", "dev", "final_number", "1")],
        "slug string, task_type string, split string, verifier string, ground_truth string")
    rows = []
    for slug in ("ok", "free", "half", "single"):
        for model in (fx.CHEAP, fx.MID):
            if slug == "half" and model == fx.MID:
                continue
            for i in range(1 if slug == "single" else 2):
                rows.append((slug, model, i, "#### 1", 10, 20, "final_number"))
    built = routing.build_records(items, costing.samples_per_item(gens(spark, rows)), fx.catalog(spark), [fx.CHEAP, fx.MID])
    assert {r["slug"]: r["skip_reason"] for r in built.select("slug", "skip_reason").distinct().collect()} == {
        "ok": None, "free": "not_gradable", "half": "incomplete", "single": "no_agreement"}
    assert routing.record_stats(built, [fx.CHEAP, fx.MID]).first().asDict() == {
        "items": 1, "skipped_not_gradable": 1, "skipped_incomplete": 1, "skipped_unpriced": 0, "skipped_no_agreement": 1, "lookups_missed": 1}
    assert {r["cost_nano"] for r in built.filter("slug = 'ok'").collect()} == {10 * 75 + 20 * 300, 10 * 1000 + 20 * 5000}


def test_published_comparison(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate([(True, True)] * 30 + [(False, False)] * 13 + [(False, True)] * 11 + [(True, False)] * 2)]
    df = spark.createDataFrame([(str(i), "x", a) for i, a, _ in rows] + [(str(i), "y", b) for i, _, b in rows], "slug string, model string, success boolean")
    r = pairing.compare_runs(df, [("x", "y")]).first()
    assert (r["n"], r["n_discordant"], r["mcnemar_p"], r["outcome"], r["mcnemar_method"]) == (56, 13, 0.02246094, "IMPROVEMENT", "exact")
    assert round(r["effect"], 6) == 0.160714 and abs(r["ci_high"] - 0.285714) <= 1 / 56 + 1e-9


def test_concordant_items_add_no_evidence(spark):
    few = spark.createDataFrame([(5, 9, 20, 1, 35)], "b bigint, c bigint, n11 bigint, n00 bigint, n bigint")
    many = spark.createDataFrame([(5, 9, 2000, 1, 2015)], "b bigint, c bigint, n11 bigint, n00 bigint, n bigint")
    assert pairing.compare(few).first()["mcnemar_p"] == pairing.compare(many).first()["mcnemar_p"]


def test_results_do_not_depend_on_partitions(spark, data):
    base = fx.records_long(spark, data)
    def run(parts):
        return sorted(map(tuple, pairing.compare_runs(base.repartition(parts), [(fx.CHEAP, fx.STRONG)], ["task_type"]).collect()))
    assert run(1) == run(4) == run(17)


def test_poisson_weights(spark):
    assert pairing.POISSON_CUTS[0] == int(2.718281828459045 ** -1 * 2**32)
    got = spark.range(20000).select(pairing.poisson_weight((uniform(F.lit("w"), F.col("id")) * 4294967296).cast("bigint")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert got[0] == pytest.approx(1.0, abs=0.03) and got[1] == pytest.approx(1.0, abs=0.05)
