"""Inputs that must be refused or reported, never guessed at; and streams over tables of several files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from compare import connect, difference
from plumbline.operators import corpus, pairing, routing, rules, similarity
from plumbline.plans import fixtures as fx, registry

registry.load_all()


def records(spark, rows):
    return spark.createDataFrame(rows, "slug string, task_type string, split string, model string, success boolean, cost_nano bigint, agreement double, verifier_confidence double")


def arms(n, strong):
    rows = [(f"i{i}", "multiple_choice", "dev", fx.CHEAP, True, 5, 0.8, None) for i in range(n)]
    return rows + [(f"i{i}", "multiple_choice", "dev", fx.STRONG, True, 9, 1.0, None) for i in range(strong)]


def test_incomplete_arms(spark):
    inputs = routing.cascade_inputs(records(spark, arms(40, 20)), fx.CHEAP, fx.STRONG)
    with pytest.raises(PySparkException, match="no success of"):
        inputs.collect()
    assert routing.cascade_inputs(records(spark, arms(4, 4)), fx.CHEAP, fx.STRONG).count() == 4


def test_unpriced_arm(spark):
    rows = [r[:5] + (None,) + r[6:] if r[3] == fx.STRONG and r[0] == "i1" else r for r in arms(3, 3)]
    with pytest.raises(PySparkException, match="no cost_nano of"):
        routing.cascade_inputs(records(spark, rows), fx.CHEAP, fx.STRONG).collect()
    items = spark.createDataFrame([("a", "t", "dev", "final_number", "1")], "slug string, task_type string, split string, verifier string, ground_truth string")
    samples = spark.createDataFrame([("a", m, 2, 1.0, True, 10, 10) for m in (fx.CHEAP, "unlisted")],
                                    "slug string, model string, samples int, agreement double, success boolean, input_tokens bigint, output_tokens bigint")
    built = routing.build_records(items, samples, fx.catalog(spark), [fx.CHEAP, "unlisted"])
    assert {r["skip_reason"] for r in built.collect()} == {"unpriced"}
    assert routing.record_stats(built, [fx.CHEAP, "unlisted"]).first()["skipped_unpriced"] == 1


def test_fit_needs_both_splits(spark):
    with pytest.raises(ValueError, match="no records in split"):
        routing.fit_and_report(records(spark, arms(4, 4)), fx.CHEAP, fx.STRONG, list(fx.LADDER), fx.STRONG, 0.8)


def test_vectors_of_one_length(spark):
    for bad in ([1.0, 2.0], None):
        rows = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", bad), ("c", [0.0, 1.0, 0.0])], "slug string, vec array<double>")
        with pytest.raises(PySparkException, match="one number of dimensions"):
            similarity.top_k_similar(*_search(rows)).collect()


def _search(rows):
    import inspect

    entries = rows.select(F.col("slug").alias("eid"), "vec")
    queries = rows.select(F.col("slug").alias("qid"), "vec")
    names = list(inspect.signature(similarity.top_k_similar).parameters)
    return (queries, entries, 1) if names[0].startswith("quer") else (entries, queries, 1)


def raw(spark, rows):
    return spark.createDataFrame(rows, "task_type string, source_dataset string, source_id string, ground_truth string, prompt string")


def test_pools_and_prompts(spark):
    rows = [("math_word_problem", "s", str(i), "1", f"prompt {i}") for i in range(6)]
    with pytest.raises(ValueError, match="no candidate at all"):
        corpus.build_corpus(raw(spark, rows), {"math_word_problem": 2, "summarization": 1}, 1)
    with pytest.raises(ValueError, match="equal prompts"):
        corpus.build_corpus(raw(spark, [(*r[:4], "the same") for r in rows]), {"math_word_problem": 6}, 1)
    assert corpus.build_corpus(raw(spark, rows), {"math_word_problem": 6}, 1).count() == 6


def test_missing_p_values_are_no_tests(spark):
    tests = spark.createDataFrame([("f", 0.01), ("f", None), ("f", 0.5)], "fam string, p_value double")
    got = {r["p_value"]: (r["q_value"], r["family_size"]) for r in pairing.bh_qvalues(tests, ["fam"]).collect()}
    assert got == {0.01: (0.02, 2), 0.5: (0.5, 2), None: (None, 2)}


def test_requests_without_values(spark):
    schema = ("model string, messages array<struct<role:string,content:string>>, n int, temperature double, top_p double, stop array<string>, "
              "max_tokens int, max_completion_tokens int")
    rows = [(None, None, None, None, None, None, None, -5), ("m", [("user", "x")], None, None, None, None, None, 7)]
    got = [r["failed_rules"] for r in rules.validate_requests(spark.createDataFrame(rows, schema)).collect()]
    assert got == [["model", "messages", "max_completion_tokens"], []]


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from plumbline.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context), "x")


@pytest.fixture(scope="module")
def in_parts(spark, data, tmp_path_factory):
    """The tables, with the events as a folder of three files."""
    import os

    folder = tmp_path_factory.mktemp("parts")
    for name in os.listdir(data):
        if name != "events.parquet":
            os.symlink(os.path.join(data, name), folder / name)
    spark.read.parquet(f"{data}/events.parquet").repartitionByRange(3, "ts").write.parquet(f"file://{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_traces_sink", "dedupe_deliveries", "stream_spend", "stream_route", "stream_failure_runs", "cache_table"])
def test_streams_read_every_file(spark, duck, in_parts, name):
    df = registry.QUERIES[name](spark, in_parts)
    assert difference(df, duck, registry.ORACLES[name]) is None
    assert df.count() > 0
