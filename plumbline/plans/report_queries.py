"""Versioned documents of comparisons, fits, calibrations and caches, byte for byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import agreement as ag, pairing
from plumbline.plans import agreement_queries as agq, comparison_queries as cq, fixtures as fx, oracle as o, routing_queries as rq, similarity_queries as sq
from plumbline.plans.registry import registered
from plumbline.sources import reports

PROVENANCE = {"seed": 20260915, "source": "given tables"}


# ---- SQL of canonical JSON: d for real numbers, i for whole numbers and flags, s for text, j for JSON -----------

def _field(column: str, kind: str) -> str:
    if kind == "d":
        units = f"floor(abs({column}::DOUBLE)*1000000.0::DOUBLE+0.5::DOUBLE)::BIGINT"
        return f"CASE WHEN {column} IS NULL THEN 'null' ELSE CASE WHEN {column}<0 AND {units}>0 THEN '-' ELSE '' END||({units}//1000000)||'.'||lpad(({units}%1000000)::VARCHAR,6,'0') END"
    return column if kind == "j" else f"coalesce({column}::VARCHAR,'null')" if kind == "i" else f"coalesce(to_json({column})::VARCHAR,'null')"


def _object(kinds: str) -> str:
    """``kinds`` lists name:kind; the SQL of an object of these columns."""
    fields = sorted(f.split(":") for f in kinds.split())
    return "'{'||" + "||','||".join(f"'\"{name}\":'||{_field(name, kind)}" for name, kind in fields) + "||'}'"


def _array(kinds: str, frm: str, order: str) -> str:
    return f"(SELECT '['||coalesce(string_agg({_object(kinds)},',' ORDER BY {order}),'')||']' FROM {frm})"


def _single(kinds: str, frm: str) -> str:
    return f"coalesce((SELECT {_object(kinds)} FROM {frm}),'null')"


def _document(kind: str, **sections: str) -> str:
    parts = {**sections, "kind": f"'\"{kind}\"'", "artifact_version": "'1'", "provenance": "'{\"seed\":20260915,\"source\":\"given tables\"}'"}
    return f"SELECT '{kind}' AS kind, '{{'||" + "||','||".join(f"'\"{n}\":'||{parts[n]}" for n in sorted(parts)) + "||'}' AS value"


# ---- documents ----------------------------------------------------------------------------

_COMPARED = ("task_type:s comparison:s baseline:s candidate:s n00:i b:i c:i n11:i missing:i n:i effect:d ci_low:d ci_high:d outcome:s significant:i detectable_effect:d "
             "can_show_equivalence:i mcnemar_p:d mcnemar_method:s n_discordant:i n_concordant:i baseline_rate:d candidate_rate:d")


@registered("comparison_document", o.query(
    _document("comparison", comparisons=_array(_COMPARED, "compared", "task_type, comparison"),
              outcomes=_array("outcome:s comparisons:i", "(SELECT outcome, count(*) AS comparisons FROM compared GROUP BY outcome)", "outcome")),
    "records", wide=cq._WIDE, paired=cq._PAIRED, counts=cq._counts(", ".join(cq._KEYS)), **o.interval_ctes("counts", cq._KEYS), compared=cq._COMPARE))
def comparison_document(spark: SparkSession, d: str) -> DataFrame:
    return reports.comparison_document(pairing.compare_runs(fx.records_long(spark, d), cq.PAIRS, ["task_type"]), ["task_type"], PROVENANCE)


_POINT = ("threshold:d n:i quality:d mean_cost_nano:d escalation_rate:d cost_ratio:d outcome:s effect:d ci_low:d ci_high:d mcnemar_p:d eligible:i "
          "baseline_quality:d baseline_mean_cost_nano:d savings:d")
_FIT = dict(
    two="SELECT * FROM swept WHERE split IN ('dev','test')",
    front="SELECT split, threshold FROM (SELECT *, max(quality) OVER (PARTITION BY split ORDER BY mean_cost_nano, quality DESC, threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM two) WHERE best IS NULL OR quality>best",
    chosen=rq._CHOSEN, picked="SELECT * FROM chosen WHERE split='dev'", held="SELECT h.* FROM two h JOIN picked p ON h.threshold=p.threshold WHERE h.split='test'",
    **rq._policy_ctes("split='dev'", "p_"), policy=rq._walk("p_rates"),
    served=rq._SERVED.format(by="", where="WHERE r.split='test'", group=""),
    cost="SELECT n, mean_cost_nano, quality, m AS strong_mean_cost_nano, mean_cost_nano/m AS cost_ratio FROM served, (SELECT max(baseline_mean_cost_nano) AS m FROM two WHERE split='test')",
    rungs=f"SELECT r.*, e.n, e.b AS k, r.ci_low>={rq.FLOOR} AS clears FROM p_rates r JOIN p_ev e USING (route_key, model)")


@registered("fit_documents", o.query(
    _document("pareto", points=_array("split:s " + _POINT, "two", "split, threshold"), frontier=_array("split:s threshold:d", "front", "split, threshold"),
              chosen=_single("eligible_points:i threshold:d quality:d mean_cost_nano:d cost_ratio:d", "picked"), held_out=_single(_POINT, "held"))
    + " UNION ALL " +
    _document("policy", routes=_array("route_key:s assigned_model:s n_items:i quality:d ci_low:d ci_high:d floor:d reason:s min_items:i rungs_considered:i", "policy", "route_key"),
              held_out_cost=_single("n:i mean_cost_nano:d quality:d strong_mean_cost_nano:d cost_ratio:d", "cost"),
              rungs=_array("route_key:s model:s n_items:i n:i k:i quality:d ci_low:d ci_high:d clears:i", "rungs", "route_key, model")),
    "records", **rq._SWEPT, **_FIT))
def fit_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.fit_documents(fx.records_long(spark, d), fx.CHEAP, fx.STRONG, fx.LADDER, fx.STRONG, rq.FLOOR, verifier_cost_nano=5000, provenance=PROVENANCE)


_CURVE = ("threshold:d hit_rate:d hit_ci_low:d hit_ci_high:d n_duplicates:i false_hit_rate:d false_hit_ci_low:d false_hit_ci_high:d n_different:i acceptable:i miss_rate:d")


@registered("cache_document", o.query(
    _document("cache", curve=_array(_CURVE, "curve", "threshold"),
              chosen=_single("n_duplicates:i n_different:i safe_points:i threshold:d hit_rate:d false_hit_rate:d false_hit_ci_high:d refusal:s", "picked"),
              tolerances=_array("tolerance:d hit_rate:d threshold:d", "priced", "tolerance")),
    "reworded", **sq._CURVED, picked=sq._CHOSEN, priced=sq._PRICE))
def cache_document(spark: SparkSession, d: str) -> DataFrame:
    return reports.cache_document(sq._pairs(spark, d), sq.GRID, PROVENANCE)


_JUDGE = ("n:i raw_agreement:d kappa:d recall_win:d recall_tie:d recall_loss:d win_win:i win_tie:i win_loss:i tie_win:i tie_tie:i tie_loss:i loss_win:i loss_tie:i loss_loss:i "
          "kappa_ci_low:d kappa_ci_high:d clears_gate:i kappa_band:s n_labelled:i n_compared:i n_unparseable:i n_missing:i flip_rate:d shown_a:i shown_b:i human_win:i human_tie:i "
          "human_loss:i judge_win:i judge_tie:i judge_loss:i median_elapsed_ms:i findings:j ground_truth_n:i ground_truth_accuracy:d")


@registered("judge_document", o.query(
    _document("calibration", judge=_single(_JUDGE, "report")), *agq.REPORT_TABLES, **agq.REPORT_CTES,
    report=agq.REPORT.format(findings="(SELECT coalesce(to_json(list(finding ORDER BY position))::VARCHAR,'[]') FROM findings)")))
def judge_document(spark: SparkSession, d: str) -> DataFrame:
    return reports.judge_document(ag.calibration_report(fx.labels(spark, d), fx.judgments(spark, d), agq._discriminable(spark, d)), PROVENANCE)
