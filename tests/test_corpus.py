"""Corpus building: sampling, splits, difficulty, identity, skewed strata."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import corpus, rules
from plumbline.operators.ranking import hash_rank, running_total, top_n
from plumbline.sources import adapters


def pool(spark, sizes):
    rows = [(task, "src", f"{i:05d}", None) for task, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "task_type string, source_dataset string, source_id string, ground_truth string")


def test_ranks_are_exact_on_a_skewed_stratum(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(7)] + [(None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "s string, k bigint").repartition(9)
    got = hash_rank(df, ["s"], 1, "k").collect()
    assert len(got) == len(rows)
    for stratum, n in (("hot", 5000), ("cold", 7), (None, 3)):
        mine = [r for r in got if r["s"] == stratum]
        assert sorted(r["draw_rank"] for r in mine) == list(range(1, n + 1)) and {r["stratum_size"] for r in mine} == {n}
    again = {(r["s"], r["k"]): r["draw_rank"] for r in hash_rank(df.repartition(2), ["s"], 1, "k", slices=64).collect()}
    assert again == {(r["s"], r["k"]): r["draw_rank"] for r in got}


def test_running_total_matches_a_plain_window(spark):
    rows = [("a" if i % 3 else None, i, i * 7 % 900, i % 11) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id bigint, sec bigint, x bigint").withColumn("ts", F.timestamp_seconds("sec"))
    total = lambda units: running_total(df.repartition(7), ["k"], "ts", ["id"], F.col("x"), "run", units)
    got, fine, coarse = ({r["id"]: r["run"] for r in total(u).collect()} for u in (("hour", "second"), ("hour", "second", "microsecond"), ("minute",)))
    assert total(("hour", "second")).columns == [*df.columns, "run"] and got == fine == coarse
    sums, want = {}, {}
    for k, i, sec, x in sorted(rows, key=lambda r: (r[2], r[1])):
        sums[k] = sums.get(k, 0) + x
        want[i] = sums[k]
    assert got == want


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = top_n(df, ["k"], [F.col("id").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_split_sizes_are_exact(spark):
    got = corpus.assign_splits(pool(spark, {"a": 103, "b": 7, "c": 1}), ["task_type"], 3, "source_id")
    sizes = {(r["task_type"], r["split"]): r["count"] for r in got.groupBy("task_type", "split").count().collect()}
    assert sizes == {("a", "calibration"): 21, ("a", "dev"): 31, ("a", "test"): 51, ("b", "calibration"): 2, ("b", "dev"): 2, ("b", "test"): 3, ("c", "calibration"): 1}


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        corpus.assign_splits(pool(spark, {"a": 3}), ["task_type"], 1, "source_id", {"calibration": 0.2, "dev": 0.2, "test": 0.2})


def built(spark, sizes, targets, parts=4):
    return {(r["slug"], r["source_id"], r["split"]) for r in corpus.build_corpus(pool(spark, sizes).repartition(parts), targets, 5).collect()}


def test_corpus_is_reproducible_and_a_new_task_changes_nothing(spark):
    first = built(spark, {"a": 60, "b": 40}, {"a": 20, "b": 10})
    assert first == built(spark, {"a": 60, "b": 40}, {"a": 20, "b": 10}, parts=1)
    more = built(spark, {"a": 60, "b": 40, "c": 30}, {"a": 20, "b": 10, "c": 5})
    assert first < more and len(more) == 35
    assert {s for s, *_ in first if s.startswith("a")} == {f"a-{i:04d}" for i in range(20)}


def test_short_pool_is_an_error(spark):
    with pytest.raises(Exception, match="too few candidates for task a"):
        corpus.build_corpus(pool(spark, {"a": 3}), {"a": 5}, 1).collect()


def test_dedupe_keeps_the_first_of_many_copies(spark):
    rows = [(i, "same") for i in range(999, 0, -1)] + [(i, f"t{i}") for i in range(1000, 1100)]
    got = corpus.dedupe_first(spark.createDataFrame(rows, "i bigint, t string").repartition(6), F.col("t"), ["i"]).collect()
    assert len(got) == 101 and min(r["i"] for r in got) == 1


def test_difficulty(spark):
    rows = [("easy", m, True, "t") for m in "ab"] + [("split", "a", True, "t"), ("split", "b", False, "t")] + [("hard", m, False, "t") for m in "ab"] + [("one", "a", False, "t")]
    pilot = spark.createDataFrame(rows, "slug string, model string, passed boolean, task_type string")
    slugs = lambda df: {r["slug"] for r in df.collect()}
    assert slugs(corpus.discriminative_items(pilot)) == {"split"}
    assert slugs(corpus.discriminative_items(pilot, mode="drop_easy")) == {"split", "hard"}
    items = spark.createDataFrame([(s, "1") for s in ("easy", "split", "hard", "new")] + [("essay", None)], "slug string, ground_truth string")
    assert slugs(corpus.filter_by_difficulty(items, pilot)) == {"split", "new", "essay"}
    assert corpus.item_outcomes(pilot).first().asDict() == {"all_models_passed": 1, "models_disagreed": 1, "all_models_failed": 2}


def test_fingerprint(spark):
    df = spark.createDataFrame([(i, f"v{i}", None) for i in range(500)], "a bigint, b string, c string")
    base = corpus.fingerprint(df, ["a", "b", "c"]).first()
    assert base == corpus.fingerprint(df.orderBy(F.col("a").desc()).repartition(17), ["c", "a", "b"]).first() and base["rows"] == 500
    changed = df.withColumn("b", F.when(F.col("a") == 7, "w").otherwise(F.col("b")))
    assert corpus.fingerprint(changed, ["a", "b", "c"]).first()["fingerprint"] != base["fingerprint"]
    doubled = corpus.fingerprint(df.union(df.limit(1)), ["a", "b", "c"]).first()
    assert doubled["fingerprint"] != base["fingerprint"] and doubled["rows"] == 501


def test_label_pairs_balance_cells(spark):
    items = spark.createDataFrame([(f"{t}-{i}", t) for t in "ab" for i in range(30)], "slug string, task_type string")
    got = corpus.label_pairs(items, ["m1", "m2"], "ref", 20, 1).collect()
    assert len(got) == 20 and len({r["pair_id"] for r in got}) == 20
    cells = {}
    for r in got:
        cells[r["task_type"], r["candidate_model"]] = cells.get((r["task_type"], r["candidate_model"]), 0) + 1
    assert set(cells.values()) == {5} and {r["candidate_shown_as"] for r in got} == {"A", "B"}


def test_invariants(spark):
    rows = [("a", "p1", True, "1", "v"), ("a", "p1", True, None, "v"), ("b", "p2", False, "1", None)]
    got = rules.check_item_invariants(spark.createDataFrame(rows, "slug string, prompt string, verifiable boolean, ground_truth string, verifier string"))
    assert {r["rule"]: r["violations"] for r in got.collect()} == {"verifiable_without_truth": 1, "truth_without_verifiable": 1, "repeated_slug": 1, "repeated_prompt": 1}


def test_adapters(spark):
    rows = spark.createDataFrame([("q", ["x", "y"], " b ", 3)], "question string, options array<string>, answer string, question_id int")
    got = adapters.normalise_source(rows, "mmlu_pro").first()
    assert got["messages"][1]["content"] == "q\n\nA. x\nB. y" and got["ground_truth"] == "B" and got["source_id"] == "3"
    rows = spark.createDataFrame([("1", "p", "3", "1\\!,234"), ("2", "p", "2", "5"), ("3", "p", "5", "\\pi"), ("4", "p", None, "5")], "unique_id string, problem string, level string, answer string")
    assert [(r["source_id"], r["ground_truth"]) for r in adapters.normalise_source(rows, "math").collect()] == [("1", "1234")]
    rows = spark.createDataFrame([(0, "x" * 30, "open_qa", None), (1, "x" * 30, "open_qa", "ctx"), (2, "short", "open_qa", ""), (3, "x" * 30, "chat", "")], "row int, instruction string, category string, context string")
    assert [r["source_id"] for r in adapters.normalise_source(rows, "dolly").collect()] == ["train-0"]


def test_prompt_files(spark):
    rows = [(1, "prompts/readme.md"), (1, "src/a.py"), (2, "prompts/judge.md"), (2, "prompts/README.md"), (3, "docs/prompts/x.md")]
    got = {r["pr"]: r["touches_prompts"] for r in rules.touches_prompts(spark.createDataFrame(rows, "pr int, filename string")).collect()}
    assert got == {1: False, 2: True, 3: False}
