"""Known answers of the column functions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import answers, money, serving, stats, text
from plumbline.operators import costing, pairing
from plumbline.sources.catalog import price_catalog


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expr(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]


# ---- answers ------------------------------------------------------------------------------

@pytest.mark.parametrize("output", [
    "#### 18", "The answer is 18.", "Final answer: 18", "\\boxed{18}", "answer is $18", "... so 18", "#### 18.0", "#### 18.00"])
def test_accepted_spellings(spark, output):
    assert column(spark, [output], lambda t: answers.verify(F.lit("final_number"), t, F.lit("18"))) == [True]


def test_final_number(spark):
    cases = {
        "first 3 then 4, #### 7": 7.0, "#### 5 no, #### 6": 6.0, "#### 1,234": 1234.0, "it is -42": -42.0, "nothing": None, "": None,
        "#### none but 9 before": 9.0, "7 apples #### (none)": 7.0, "ANSWER IS 3": 3.0, "1 2 3.50": 3.5}
    assert column(spark, list(cases), answers.extract_final_number) == list(cases.values())


def test_truth_forms(spark):
    assert column(spark, ["$1,234.", "12", "x", "inf"], answers.as_number) == [1234.0, 12.0, None, None]


def test_choice(spark):
    cases = {
        "#### D": "D", "The answer is D": "D", "Answer: D": "D", "\\boxed{D}": "D", "answer is (D)": "D", "D": "D", "answer is A, no, answer is B": "B",
        "": None, "I like option c": "C", "think\nmaybe B\n\n": "B", "none here": None, "été A": "A", "éA": None}
    assert column(spark, list(cases), answers.extract_choice) == list(cases.values())


def test_unknown_verifier_is_an_error(spark):
    with pytest.raises(Exception, match="unknown verifier"):
        column(spark, ["x"], lambda t: answers.verify(F.lit("nope"), t, F.lit("1")))


def test_ungradable_is_null(spark):
    assert column(spark, ["x"], lambda t: answers.verify(F.lit(None).cast("string"), t, F.lit("1"))) == [None]


def test_user_verifier(spark):
    answers.register_verifier("starts_with", lambda o, t: o.startswith(t), lambda o: F.substring(o, 1, 1))
    try:
        assert column(spark, ["abc", "xbc"], lambda t: answers.verify(F.lit("starts_with"), t, F.lit("a"))) == [True, False]
    finally:
        answers._VERIFIERS.pop("starts_with")


def test_judge_reply(spark):
    good = {
        '{"outcome": "A", "confidence": 0.9}': ("A", 0.9), '```json\n{"outcome": "B"}\n```': ("B", 0.5), 'Well: {"outcome": "tie", "confidence": 1} ok': ("tie", 1.0),
        '{"outcome": "A", "extra": [1]}': ("A", 0.5), '```\nnot json\n``` {"outcome": "B"}': ("B", 0.5)}
    bad = ["", "   ", "null", '{"outcome": "C"}', '{"outcome": "A", "confidence": 5}', '{"outcome": "A", "confidence": null}', '[1]', "A wins",
           '{"outcome": "A", "reasoning": 3}', '{"confidence": 0.4}']
    got = column(spark, [*good, *bad], answers.parse_judge_reply)
    assert [(r["outcome"], r["confidence"]) for r in got[: len(good)]] == list(good.values())
    assert got[len(good):] == [None] * len(bad)


def test_positions(spark):
    rows = [("A", "A", "win"), ("A", "B", "loss"), ("tie", "A", "tie"), (None, "A", None)]
    df = spark.createDataFrame(rows, "o string, s string, want string")
    for r in df.withColumn("got", answers.to_candidate_outcome(F.col("o"), F.col("s"))).collect():
        assert r["got"] == r["want"]
    pairs = spark.createDataFrame([("win", "win", "win"), ("win", "loss", "tie"), ("win", None, None)], "a string, b string, want string")
    for r in pairs.withColumn("got", answers.combine_positions(F.col("a"), F.col("b"))).collect():
        assert r["got"] == r["want"]


# ---- money --------------------------------------------------------------------------------

def test_nano_prices(spark):
    assert column(spark, [1.0, 0.075, 25.0, 6.25, 0.05], money.nano_per_token, "double") == [1000, 75, 25000, 6250, 50]


CATALOG = [("oss-small", 0.075, 0.30, None, None), ("mid", 3.0, 15.0, 0.3, 3.75), ("small", 1.0, 5.0, 0.1, 1.25)]


def test_costs(spark):
    catalog = price_catalog(spark.createDataFrame(CATALOG, "model string, input double, output double, cache_read double, cache_write double"))
    usage = spark.createDataFrame(
        [(0, "oss-small", 1234, 567, 0), (1, "small", 14, 11, 0), (2, "oss-small", 1, 1, 5), (3, "elsewhere", 1, 1, 0), (4, "small", -1, 1, 0), (5, "small", 1000, 0, 10)],
        "i int, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint")
    got = {r["i"]: (r["cost_nano"], r["cost_error"]) for r in costing.price_usage(usage, catalog).collect()}
    assert got == {0: (262650, None), 1: (69000, None), 2: (None, "unverified cache_read price"), 3: (None, "unknown model"),
                   4: (None, "negative input_tokens"), 5: (1001000, None)}
    assert column(spark, [69000], money.nano_to_usd, "bigint") == [0.000069]


def test_missing_price_in_catalog_is_an_error(spark):
    bad = spark.createDataFrame([("m", None, 1.0, None, None)], "model string, input double, output double, cache_read double, cache_write double")
    with pytest.raises(Exception, match="no verified price for m"):
        price_catalog(bad).collect()


# ---- text and keys ------------------------------------------------------------------------

MESSAGES = "array<struct<role:string,content:string>>"


def test_canonical_form(spark):
    a = [(" User ", "  hi \n\t there  ")]
    b = [("user", "hi there")]
    got = column(spark, [a, b, [("user", "there hi")]], text.canonicalise, MESSAGES)
    assert got[0] == got[1] == "user:hi there" and got[2] != got[0]


def test_embedding_text_uses_spoken_turns(spark):
    both = [("system", "S"), ("user", "U"), ("assistant", "A")]
    got = column(spark, [both, [("system", "S")]], text.embedding_text, MESSAGES)
    assert got == ["user:U\nassistant:A", "system:S"]
    assert column(spark, [both, [("system", "S")]], text.user_prompt_text, MESSAGES) == ["U\n\nA", "S"]
    assert column(spark, [both], text.prompt_text, MESSAGES) == ["S\n\nU\n\nA"]


def test_exact_key_ignores_parameter_order_only(spark):
    def key(params, model="m", version="v", canonical="user:hi"):
        cols = F.create_map(*[F.lit(x) for kv in params for x in kv])
        return spark.range(1).select(text.exact_key(F.lit(canonical), F.lit(model), F.lit(version), cols)).first()[0]

    base = key([("a", "1"), ("b", "2")])
    assert base == key([("b", "2"), ("a", "1")])
    payload = '{"messages":"user:hi","model":"m","promptVersion":"v","params":{"a":1,"b":2}}'
    assert base == hashlib.sha256(payload.encode()).hexdigest()
    assert len({base, key([("a", "1")]), key([("a", "1"), ("b", "2")], model="n"), key([("a", "1"), ("b", "2")], version="w")}) == 4


def test_cache_key_is_the_hash_of_sorted_compact_json(spark):
    content = 'He said "no" / é\n'
    payload = {"messages": [{"role": "user", "content": content}], "model": "m", "params": {"max_tokens": 1024, "temperature": 0.0}, "replicate_idx": 2}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit(content).alias("content")))
    params = text.request_params(F.lit(1024), F.lit(4096), F.lit(True))
    got = spark.range(1).select(text.cache_key(F.lit("m"), messages, params, F.lit(2))).first()[0]
    assert got == want


def test_token_estimates(spark):
    assert column(spark, [0, 3, 4, 9], text.token_estimate, "int") == [1, 1, 1, 2]
    assert column(spark, [0, 3, 9], text.worst_case_tokens, "int") == [1, 1, 3]


# ---- serving ------------------------------------------------------------------------------

def test_failure_classes(spark):
    kinds = spark.createDataFrame([(k,) for k in ("rate_limited", "bad_request", "provider_5xx", "auth", "connection", "timeout", "odd")], "kind string")
    got = {r["kind"]: (r["f"]["counts_toward_breaker"], r["f"]["retryable"], r["f"]["http_status"]) for r in kinds.withColumn("f", serving.classify_failure(F.col("kind"))).collect()}
    assert got["rate_limited"] == (False, True, 429) and got["bad_request"] == (False, False, 400)
    assert got["provider_5xx"] == (True, True, 502) and got["auth"] == (True, False, 502) and got["odd"] == (True, False, 502)
    assert got["timeout"] == (True, True, 504)
    listed = {r["kind"]: r["http_status"] for r in serving.failure_kinds(spark).collect()}
    assert listed["rate_limited"] == 429 and len(listed) == 7


def test_zero_lifetime_is_allowed(spark):
    ttl = serving.ttl_seconds(F.col("v"), 60, {"volatile": 0})
    assert column(spark, ["volatile", "calm", None], lambda _: ttl) == [0, 60, 60]


# ---- statistics ---------------------------------------------------------------------------

def counts(spark, rows, schema="b bigint, c bigint"):
    return spark.createDataFrame(rows, schema)


def test_exact_mcnemar(spark):
    import math

    rows = [(b, c) for b in range(13) for c in range(12)]
    got = counts(spark, rows).select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p"), stats.mcnemar_p(F.col("b"), F.col("c"), "exact").alias("q")).collect()
    for r in got:
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert r["p"] == want and r["q"] == pytest.approx(want, rel=1e-10)
    published = counts(spark, [(11, 2), (7, 16)]).select(F.round(stats.mcnemar_p(F.col("b"), F.col("c")), 8)).collect()
    assert [r[0] for r in published] == [0.02246094, 0.09313965]


def test_yates(spark):
    rows = [(30, 10), (50, 30), (100, 70), (40, 25)]
    got = counts(spark, rows).select("b", "c", stats.yates_statistic(F.col("b"), F.col("c")).alias("x"), stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        want = (abs(r["b"] - r["c"]) - 1) ** 2 / (r["b"] + r["c"])
        assert r["x"] == pytest.approx(want)
    # Reference values of the chi-square tail with one degree of freedom.
    assert got[0]["p"] == pytest.approx(0.0026635, abs=1e-6)
    with pytest.raises(ValueError):
        stats.mcnemar_p(F.col("b"), F.col("c"), "guess")


def interval(spark, n, up, down, resamples=stats.RESAMPLES):
    row = counts(spark, [(n, up, down)], "n bigint, b bigint, c bigint").select(stats.paired_interval(F.col("n"), F.col("b"), F.col("c"), resamples=resamples).alias("r")).first()
    return row["r"]["low"], row["r"]["high"]


def test_published_interval(spark):
    assert interval(spark, 197, 7, 16) == (-18, 0)
    low, high = interval(spark, 56, 11, 2)
    assert abs(low - 3) <= 1 and abs(high - 16) <= 1


def test_identical_and_opposite_arms(spark):
    assert interval(spark, 80, 0, 0) == (0, 0)
    assert interval(spark, 80, 0, 80) == (-80, -80)
    low, high = interval(spark, 100, 0, 20)
    assert low < -20 < high < 0


def test_interval_matches_brute_force_resampling():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, up, down in [(40, 6, 3), (150, 30, 12), (25, 0, 5)]:
        draws = rng.multinomial(n, [up / n, down / n, 1 - (up + down) / n], size=400_000)
        diff = np.sort(draws[:, 0] - draws[:, 1])
        low, high = stats._percentile_counts(n, up, down, 0.05, 10_000)
        assert abs(low - diff[int(0.025 * len(diff))]) <= 1 and abs(high - diff[int(0.975 * len(diff))]) <= 1


def test_interval_of_many_items():
    low, high = stats._percentile_counts(10**9, 10**8, 2 * 10**8, 0.05, 10_000)
    sd = (10**9 * (0.3 - 0.01)) ** 0.5
    assert low == pytest.approx(-(10**8) - 1.96 * sd, rel=1e-3) and high == pytest.approx(-(10**8) + 1.96 * sd, rel=1e-3)


def test_interval_coverage():
    """A 95 % interval should hold the truth about 95 times in 100."""
    import numpy as np

    rng = np.random.default_rng(11)
    held = 0
    for _ in range(300):
        up, down, _rest = rng.multinomial(200, [0.15, 0.10, 0.75])
        low, high = stats._percentile_counts(200, int(up), int(down), 0.05, 10_000)
        held += low <= 0.05 * 200 <= high
    assert 270 <= held <= 300


@pytest.mark.parametrize("low,high,margin,want", [
    (-0.2, -0.06, 0.05, "REGRESSION"), (0.06, 0.2, 0.05, "IMPROVEMENT"), (-0.05, 0.05, 0.05, "EQUIVALENT"), (-0.012, -0.004, 0.05, "EQUIVALENT"),
    (-0.06, 0.0, 0.05, "INCONCLUSIVE"), (-0.2, 0.2, 0.05, "INCONCLUSIVE"), (-0.2, -0.05, 0.05, "INCONCLUSIVE"), (-0.2, -0.01, 0.0, "REGRESSION")])
def test_classify(spark, low, high, margin, want):
    assert spark.range(1).select(stats.classify_interval(F.lit(low), F.lit(high), margin)).first()[0] == want


@pytest.mark.parametrize("low,high,margin", [(0.2, 0.1, 0.05), (0.1, 0.2, -0.05)])
def test_classify_refuses_nonsense(spark, low, high, margin):
    df = spark.range(1).select(F.lit(low).alias("l"), F.lit(high).alias("h"))
    with pytest.raises(Exception):
        df.select(stats.classify_interval(F.col("l"), F.col("h"), margin)).collect()


def test_exact_bounds(spark):
    got = counts(spark, [(0, 150), (150, 150), (0, 20), (0, 368), (0, 367), (8, 600)], "k bigint, n bigint").select("k", "n", stats.exact_bounds(F.col("k"), F.col("n")).alias("r")).collect()
    by = {(r["k"], r["n"]): (r["r"]["low"], r["r"]["high"]) for r in got}
    assert by[0, 150] == (0.0, pytest.approx(0.0243, abs=5e-5)) and by[150, 150][1] == 1.0
    assert by[0, 20][1] > 0.01 and by[0, 368][1] <= 0.01 < by[0, 367][1]
    assert by[8, 600][1] == pytest.approx(0.0261, abs=1e-4)


def test_exact_bounds_invert_the_binomial_tail():
    import math
    import numpy as np

    for k, n in [(3, 50), (17, 90), (1, 1000)]:
        high = float(stats._exact_upper(np.array([float(k)]), np.array([float(n)]), 0.05)[0])
        tail = sum(math.comb(n, i) * high**i * (1 - high) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(0.025, abs=1e-9)
    big = stats._exact_upper(np.array([3e5]), np.array([3e6]), 0.05)[0]
    assert big == pytest.approx(0.1 + 1.96 * (0.09 / 3e6) ** 0.5, abs=2e-6)


def test_min_trials(spark):
    assert column(spark, [0.01, 0.1], stats.min_trials, "double") == [368, 36]


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_bh(spark, slices):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    order = [3, 0, 9, 5, 1, 7, 2, 8, 4, 6]
    df = spark.createDataFrame([(i, p[i], "f") for i in order], "i int, p_value double, f string")
    got = {r["i"]: r["q_value"] for r in pairing.bh_qvalues(df, ["f"], slices=slices).collect()}
    want, running = {}, 1.0
    for rank in range(10, 0, -1):
        running = min(running, p[rank - 1] * 10 / rank)
        want[rank - 1] = round(running, 8)
    assert got == pytest.approx(want)
    with pytest.raises(Exception, match="p-value lies outside"):
        pairing.bh_qvalues(spark.createDataFrame([(1.5, "f")], "p_value double, f string"), ["f"]).collect()


def test_a_large_family_in_four_ranges(spark):
    """Ties, a value that a third of the rows share, rows without a value and a family without a name."""
    import numpy as np

    rng = np.random.default_rng(3)
    p = np.where(rng.random(900) < 0.33, 1.0, np.round(rng.random(900) ** 3, 3))
    rows = [(i, None if i % 50 == 0 else float(x), None if i % 7 == 0 else "f") for i, x in enumerate(p)]
    got = {r["i"]: (r["q_value"], r["family_size"]) for r in pairing.bh_qvalues(
        spark.createDataFrame(rows, "i int, p_value double, f string").repartition(6), ["f"], slices=4).collect()}
    assert len(got) == 900
    for name in (None, "f"):
        tests = sorted((x, i) for i, x, f in rows if f == name and x is not None)
        least, want = 1.0, {}
        for rank in range(len(tests), 0, -1):
            x, i = tests[rank - 1]
            least = min(least, x * len(tests) / rank)
            want[i] = (round(least, 8), len(tests))
        assert {i: got[i] for i in want} == {i: (pytest.approx(q, abs=1e-9), n) for i, (q, n) in want.items()}
        assert all(got[i] == (None, len(tests)) for i, x, f in rows if f == name and x is None)


def test_required_items(spark):
    got = spark.createDataFrame([(0.05, 0.2), (0.3, 0.2), (0.0, 0.2)], "e double, r double").select(stats.required_items(F.col("e"), F.col("r"))).collect()
    assert got[0][0] == 628 and got[1][0] == 0 and got[2][0] is None
