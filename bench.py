"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

With ``BENCH_NAIVE=1``, ``naive`` adds the straightforward formulation of three of them for
comparison: twenty resamples of the rows, one pass per threshold, an unblocked self-join.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window, functions as F  # noqa: E402

from plumbline.operators import routing, similarity  # noqa: E402
from plumbline.plans import fixtures as fx, registry  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = [
    "compare_runs", "mcnemar", "cascade_outcomes", "sweep", "fit_and_report", "fit_offline_policy", "build_records", "grade_generations", "self_consistency",
    "run_summary", "project_cost", "assemble_traces", "spend_by_hour", "cumulative_spend", "failure_runs", "latency_profile",
    "hard_negatives", "semantic_lookup", "calibrate_threshold", "build_corpus", "assign_splits", "dedupe_first", "fingerprint",
    "score_judge_log", "calibration_report", "request_keys", "conversation_keys", "route_traffic", "stream_spend", "assemble_traces_stream",
]


def naive_sweep(spark, d):
    """Records once per threshold."""
    inputs = routing.cascade_inputs(fx.records_long(spark, d), fx.CHEAP, fx.STRONG, 3, 5000)
    grid = F.explode(F.array(*[F.lit(float(t)) for t in routing.SWEEP_GRID]))
    up = F.col("confidence") < F.col("t")
    return inputs.withColumn("t", grid).groupBy("split", "t").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.when(up, F.col("strong_ok")).otherwise(F.col("cheap_ok"))).alias("ok"),
        F.sum(F.col("check_nano") + F.when(up, F.col("strong_nano")).otherwise(0)).alias("cost"))


def naive_resampling(spark, d):
    """Twenty weighted copies of every paired row; the real number would be thousands."""
    from plumbline.functions.hashing import uniform
    from plumbline.operators import pairing

    paired = pairing.pair_arms(fx.records_long(spark, d), [(fx.CHEAP, fx.MID)], ["task_type"])
    drawn = paired.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn(
        "w", pairing.poisson_weight((uniform(F.lit("b"), F.col("slug"), F.col("r")) * 4294967296).cast("bigint")))
    return drawn.groupBy("task_type", "r").agg(F.sum("w").alias("n"), F.sum(F.col("w") * (F.col("b").cast("int") - F.col("a").cast("int"))).alias("gap"))


def naive_neighbours(spark, d):
    v = fx.vectors(spark, d).select("slug", similarity.fixed_point(F.col("vec")).alias("v"))
    other = v.select(F.col("slug").alias("s2"), F.col("v").alias("v2"))
    scored = v.join(other, F.col("slug") != F.col("s2")).withColumn("s", similarity.cosine(F.col("v"), F.col("v2")))
    best = F.row_number().over(Window.partitionBy("slug").orderBy(F.col("s").desc(), F.col("s2").desc()))
    return scored.withColumn("rk", best).filter("rk = 1").select("slug", "s2", "s")


NAIVE = {"cascade_outcomes": naive_sweep, "compare_runs": naive_resampling, "hard_negatives": naive_neighbours}


def timed(query, spark, d) -> float:
    start = time.perf_counter()
    query(spark, d).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    registry.load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, 2 * int(cpus)) if cpus.isdigit() else 16),
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    timed(registry.QUERIES["contingency"], spark, d)  # start-up and code generation are not part of any query
    names = only or HEADLINE
    seconds = {name: timed(registry.QUERIES[name], spark, d) for name in names}
    rows = {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("orders", "lineitem", "events", "documents", "embeddings")}
    naive = {name: timed(query, spark, d) for name, query in NAIVE.items() if name in names} if os.environ.get("BENCH_NAIVE") else {}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "naive": naive,
        "rows": rows, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
