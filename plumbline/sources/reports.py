"""Versioned reports: one JSON document of rows and single objects, the same bytes for the same results.

A document holds its kind, its version, where it came from and named sections. Its sections are results of
aggregations, one row for a threshold, a route or a comparison, so a document is small whatever it was made from.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import stats
from plumbline.functions.documents import canonical, json_array, json_object
from plumbline.operators import routing, similarity
from plumbline.session import stored

VERSION = 1


def _as_object(df: DataFrame) -> Column:
    return json_object({f.name: canonical(F.col(f.name), f.dataType) for f in df.schema.fields})


def rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A section: an array of the rows as objects, in this order; no rows are an empty array."""
    at = F.struct(*[F.col(c) for c in order], _as_object(df).alias("_text"))
    return df.select(at.alias("_row")).agg(json_array(F.transform(F.array_sort(F.collect_list("_row")), lambda r: r["_text"])).alias("section"))


def single(df: DataFrame) -> DataFrame:
    """A section: the only row as an object, ``null`` if there is none; more rows are refused."""
    text = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a section of one row has several")).cast("string")).otherwise(F.max("_text"))
    return df.select(_as_object(df).alias("_text")).agg(F.coalesce(text, F.lit("null")).alias("section"))


def document(kind: str, sections: dict[str, DataFrame], provenance: dict[str, str | int | bool] | None = None, version: int = VERSION) -> DataFrame:
    """One row (kind, value): the sections with kind, version and provenance, names in order."""
    fixed = {"kind": kind, "artifact_version": version, "provenance": provenance or {}}
    if clash := set(fixed) & set(sections):
        raise ValueError(f"sections may not be called {sorted(clash)}")
    parts = {name: F.lit(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for name, value in fixed.items()}
    named = [df.select(F.col("section").alias(f"s_{name}"), F.lit(1).alias("_one")) for name, df in sections.items()]  # one row each
    joined = reduce(lambda a, b: a.join(b, "_one"), named)
    return joined.select(F.lit(kind).alias("kind"), json_object({**parts, **{name: F.col(f"s_{name}") for name in sections}}).alias("value"))


def write_document(doc: DataFrame, path: str) -> None:
    """A document is one line of one file."""
    doc.select("value").coalesce(1).write.mode("overwrite").text(path)


def comparison_document(compared: DataFrame, by: Sequence[str] = (), provenance: dict | None = None) -> DataFrame:
    """All comparisons with interval, test and outcome, and how many had which outcome."""
    compared = stored(compared, "comparisons")
    outcomes = compared.groupBy("outcome").agg(F.count(F.lit(1)).alias("comparisons"))
    return document("comparison", {"comparisons": rows(compared, [*by, "comparison"]), "outcomes": rows(outcomes, ["outcome"])}, provenance)


def fit_documents(records: DataFrame, cheap: str, strong: str, ladder: Sequence[str], safe_default: str, floor: float,
                  grid: Sequence[float] = routing.SWEEP_GRID, k_samples: int = 3, verifier_cost_nano: int = 0,
                  margin: float = stats.MARGIN, provenance: dict | None = None) -> DataFrame:
    """Two rows, the documents ``pareto`` and ``policy`` of one fit.

    ``pareto``: every threshold of both splits, the frontier, the point chosen on the fit split and the same
    threshold on the report split, ``null`` where none was shown non-inferior. ``policy``: the route of every
    task, every rung that was considered with its bounds, and what the routes cost on the report split. The
    records are read for the sweep, for the rungs and for the sizes of routes; all else is read off those sums.
    """
    both = records.filter(F.col("split").isin(routing.FIT_SPLIT, routing.REPORT_SPLIT))
    routing.require_one_split(both)
    routing._require_splits(both)
    points = stored(routing.sweep(routing.cascade_inputs(both, cheap, strong, k_samples, verifier_cost_nano), grid, margin=margin), "sweep")
    chosen = routing.operating_point(points).filter(F.col("split") == routing.FIT_SPLIT)
    held = points.filter(F.col("split") == routing.REPORT_SPLIT).join(chosen.select("threshold"), "threshold")
    pareto = document("pareto", {
        "points": rows(points, ["split", "threshold"]),
        "frontier": rows(routing.pareto_frontier(points).select("split", "threshold"), ["split", "threshold"]),
        "chosen": single(chosen.drop("split")), "held_out": single(held.drop("split"))}, provenance)

    sums = stored(both.groupBy("split", "task_type", "model").agg(
        F.count("success").alias("n"), F.count_if("success").alias("k"),
        F.sum(F.when(F.col("success").isNotNull(), F.col("cost_nano"))).alias("cost_nano")), "rungs")
    fit = sums.filter((F.col("split") == routing.FIT_SPLIT) & F.col("model").isin(*ladder)).withColumnRenamed("task_type", "route_key")
    sizes = both.filter(F.col("split") == routing.FIT_SPLIT).select(F.col("task_type").alias("route_key"), "slug").distinct().groupBy("route_key").agg(
        F.count(F.lit(1)).alias("n_items"))
    bounds = stored(routing.route_bounds(fit.select("route_key", "model", "n", "k").join(sizes, "route_key")), "bounds")
    policy = stored(routing.ladder_walk(bounds, ladder, safe_default, floor), "policy")
    served = sums.filter(F.col("split") == routing.REPORT_SPLIT).join(
        policy.select(F.col("route_key").alias("task_type"), F.col("assigned_model").alias("model")), ["task_type", "model"]).agg(
        F.sum("n").alias("n"), (F.sum("cost_nano") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_cost_nano"),
        (F.sum("k") / F.nullif(F.sum("n"), F.lit(0))).alias("quality"))
    baseline = points.filter(F.col("split") == routing.REPORT_SPLIT).agg(F.max("baseline_mean_cost_nano").alias("strong_mean_cost_nano"))
    one = F.lit(1).alias("_one")
    cost = served.select("*", one).join(baseline.select("*", one), "_one").drop("_one").withColumn(
        "cost_ratio", F.col("mean_cost_nano") / F.nullif(F.col("strong_mean_cost_nano"), F.lit(0.0)))
    fitted = document("policy", {
        "routes": rows(policy, ["route_key"]), "held_out_cost": single(cost),
        "rungs": rows(bounds.select("route_key", "model", "n_items", "n", "k", "quality", "ci_low", "ci_high", (F.col("ci_low") >= floor).alias("clears")), ["route_key", "model"]),
    }, provenance)
    return pareto.unionByName(fitted)


def judge_document(report: DataFrame, provenance: dict | None = None) -> DataFrame:
    """The headline row of a judge calibration, findings as a list."""
    return document("calibration", {"judge": single(report)}, provenance)


def cache_document(pairs: DataFrame, grid: Sequence[float] = similarity.CACHE_GRID, provenance: dict | None = None) -> DataFrame:
    """Every threshold of a cache with its bounds, the chosen one or why there is none, and what other tolerances would buy."""
    curve = stored(similarity.calibrate_threshold(pairs, grid), "curve")
    return document("cache", {
        "curve": rows(curve, ["threshold"]), "chosen": single(similarity.chosen_threshold(curve)),
        "tolerances": rows(similarity.price_of_usefulness(curve), ["tolerance"])}, provenance)
