"""Joins of two sides that grow with the data: neither goes whole through the driver."""

from pyspark.sql import functions as F

from plumbline.operators import costing
from plumbline.plans import comparison_queries, registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_meet_the_cache_without_a_broadcast(spark):
    tasks = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", None)], "slug string, cache_key string")
    cache = spark.createDataFrame([("k1",), ("k1",), ("k3",), (None,)], "cache_key string")
    for found, want in ((costing.pending_tasks(tasks, cache), ["b", "c"]), (costing.cached_tasks(tasks, cache), ["a"])):
        assert sorted(r["slug"] for r in found.collect()) == want
        assert "Broadcast" not in plan_of(found)


def test_order_days_meet_the_arms_without_a_broadcast(spark, data):
    assert "Broadcast" not in plan_of(comparison_queries.mcnemar(spark, data))
    counts = registry.QUERIES["mcnemar"](spark, data).agg(F.count(F.lit(1)), F.sum(F.col("b") + F.col("c"))).first()
    assert counts[0] > 0 and counts[1] > 0
