"""Judges and people: replies, confusion tables, kappa, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import agreement as ag
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.planning_queries import CHOICE_SQL, NUMBER_SQL
from plumbline.plans.registry import registered

_VALID = "json_valid({x}) AND json_type({x})='OBJECT' AND ({x}::JSON->>'$.outcome') IN ('A','B','tie') AND coalesce(({x}::JSON->>'$.confidence')::DOUBLE,0.5) BETWEEN 0 AND 1"
_PARSED = f"""SELECT pair_id, position, CASE WHEN {_VALID.format(x='fenced')} THEN fenced WHEN {_VALID.format(x='obj')} THEN obj WHEN {_VALID.format(x='raw2')} THEN raw2 END AS doc FROM (
  SELECT pair_id, position, nullif(regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)\\s*```',1),'') AS fenced, nullif(regexp_extract(raw,'(?s)\\{{.*\\}}',0),'') AS obj, nullif(trim(raw),'') AS raw2 FROM replies)"""
_SLOTS = """SELECT pair_id, position, CASE WHEN doc IS NULL THEN NULL WHEN doc::JSON->>'$.outcome'='tie' THEN 'tie' WHEN doc::JSON->>'$.outcome'=position THEN 'win' ELSE 'loss' END AS outcome,
  CASE WHEN doc IS NOT NULL THEN coalesce((doc::JSON->>'$.confidence')::DOUBLE,0.5) END AS conf FROM parsed"""
_JUDGED = """SELECT pair_id, a AS outcome_a, b AS outcome_b, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a=b THEN a ELSE 'tie' END AS outcome,
  coalesce(a<>b,false) AS position_flip, a IS NULL OR b IS NULL AS unparseable, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round_even((ca+cb)/2.0,4) END AS confidence FROM (
  SELECT pair_id, max(outcome) FILTER (position='A') AS a, max(outcome) FILTER (position='B') AS b, max(conf) FILTER (position='A') AS ca, max(conf) FILTER (position='B') AS cb FROM slots GROUP BY pair_id)"""


@registered("parse_judge_replies", o.query("SELECT pair_id, position, outcome, conf AS confidence FROM slots", "replies", parsed=_PARSED, slots=_SLOTS))
def parse_judge_replies(spark, d):
    from plumbline.functions import answers
    return fx.judge_replies(spark, d).withColumn("_r", answers.parse_judge_reply(F.col("raw"))).select(
        "pair_id", "position", answers.to_candidate_outcome(F.col("_r.outcome"), F.col("position")).alias("outcome"), "_r.confidence")


@registered("score_judge_log", o.query("SELECT * FROM judged", "replies", parsed=_PARSED, slots=_SLOTS, judged=_JUDGED))
def score_judge_log(spark, d):
    return ag.score_judge_log(fx.judge_replies(spark, d))


@registered("join_labels_judgments", o.query("SELECT pair_id, human, outcome, status FROM joined", "joined"))
def join_labels_judgments(spark, d):
    return ag.join_labels_judgments(fx.labels(spark, d), fx.judgments(spark, d)).select("pair_id", "human", "outcome", "status")


_JOINED = lambda spark, d: ag.join_labels_judgments(fx.labels(spark, d), fx.judgments(spark, d))
_COMPARED = lambda spark, d: _JOINED(spark, d).filter("status = 'compared'")
_CELLS = f"SELECT {o.CELL_COLUMNS} FROM joined WHERE status='compared'"
_TASK_CELLS = f"SELECT task_type, {o.CELL_COLUMNS} FROM joined WHERE status='compared' GROUP BY task_type"
_N = "(win_win+win_tie+win_loss+tie_win+tie_tie+tie_loss+loss_win+loss_tie+loss_loss)"
_ROW = {"win": "(win_win+win_tie+win_loss)", "tie": "(tie_win+tie_tie+tie_loss)", "loss": "(loss_win+loss_tie+loss_loss)"}
_COL = {"win": "(win_win+tie_win+loss_win)", "tie": "(win_tie+tie_tie+loss_tie)", "loss": "(win_loss+tie_loss+loss_loss)"}
_CHANCE = "(" + "+".join(f"{_ROW[k]}::DOUBLE*{_COL[k]}::DOUBLE" for k in stats.CLASSES) + ")"
_HITS = "(win_win+tie_tie+loss_loss)"
_KAPPA = f"CASE WHEN {_N}=0 OR {_N}::DOUBLE*{_N}::DOUBLE={_CHANCE} THEN 0.0 ELSE ({_HITS}*{_N}::DOUBLE-{_CHANCE})/({_N}::DOUBLE*{_N}::DOUBLE-{_CHANCE}) END"
_AGREED_COLUMNS = f"SELECT {{by}} {_N} AS n, {_HITS}/{_N}::DOUBLE AS raw_agreement, {_KAPPA} AS kappa, " + ", ".join(
    f"CASE WHEN {_ROW[k]}>0 THEN {k}_{k}/{_ROW[k]}::DOUBLE ELSE 0.0 END AS recall_{k}" for k in stats.CLASSES) + ", " + ", ".join(
    f"{h}_{j}" for h in stats.CLASSES for j in stats.CLASSES)
_AGREED = _AGREED_COLUMNS + " FROM cells"
_AGREED_SEEDED = _AGREED_COLUMNS + " FROM seeded"


@registered("confusion", o.query(
    "SELECT split_part(name,'_',1) AS human, split_part(name,'_',2) AS judge, n FROM (UNPIVOT cells ON COLUMNS(*) INTO NAME name VALUE n)", "joined", cells=_CELLS))
def confusion(spark, d):
    return ag.confusion_long(ag.confusion(_COMPARED(spark, d)))


@registered("agreement", o.query(_AGREED.format(by=""), "joined", cells=_CELLS))
def agreement(spark, d):
    return ag.agreement(ag.confusion(_COMPARED(spark, d)))


@registered("agreement_by_task", o.query(f"SELECT * FROM ({_AGREED.format(by='task_type,')}) WHERE n>=5", "joined", cells=_TASK_CELLS))
def agreement_by_task(spark, d):
    return ag.agreement_by_task(_COMPARED(spark, d))


# The redraws of the nine cells of every row of ``seeded``, which names the row in ``seed``.
_M = "12*sqrt(m)"
_REDRAWN = dict(
    counted="SELECT seed, unnest(range(9)) AS cell, unnest([" + ",".join(f"{h}_{j}" for h in stats.CLASSES for j in stats.CLASSES) + "])::BIGINT AS m FROM seeded",
    mass=f"""SELECT seed, cell, k, exp(k*ln(m)-m-lgamma(k+1)) AS p FROM (
      SELECT *, unnest(range(greatest(0,floor(m-{_M}))::BIGINT, ceil(m+{_M})::BIGINT+21)) AS k FROM counted WHERE m>0)""",
    below="SELECT seed, cell, k, sum(p) OVER (PARTITION BY seed, cell ORDER BY k) AS c FROM mass",
    hashed=f"SELECT seed, cell, m, blk, md5(concat_ws('|',seed,cell,blk)) AS h FROM counted, range({stats.RESAMPLES // 4}) b(blk)",
    units="SELECT seed, cell, m, blk*4+lane AS r, ('0x'||substr(h,1+8*lane,8))::BIGINT/4294967296.0::DOUBLE AS u FROM hashed, range(4) l(lane)",
    drawn=f"""SELECT u.seed, u.r, u.cell, CASE WHEN m=0 THEN 0 ELSE coalesce(b.k+1, greatest(0,floor(m-{_M}))::BIGINT) END AS x
      FROM units u ASOF LEFT JOIN below b ON u.seed=b.seed AND u.cell=b.cell AND u.u>=b.c""",
    draws="SELECT seed, r, " + ", ".join(f"max(x) FILTER (cell={3 * i + j})::BIGINT AS {h}_{k}" for i, h in enumerate(stats.CLASSES) for j, k in enumerate(stats.CLASSES))
          + " FROM drawn GROUP BY ALL",
    ordered=f"SELECT seed, list_sort(list({_KAPPA})) AS ks FROM draws GROUP BY seed",
    bounds=f"""SELECT seed, CASE WHEN {_N}<2 THEN 0.0::DOUBLE ELSE round(ks[{int(stats.ALPHA / 2 * stats.RESAMPLES) + 1}],4) END AS low,
      CASE WHEN {_N}<2 THEN 0.0::DOUBLE ELSE round(ks[{int((1 - stats.ALPHA / 2) * stats.RESAMPLES) + 1}],4) END AS high FROM ordered JOIN seeded USING (seed)""")
_BAND = """CASE WHEN kappa<0 THEN 'worse than chance' WHEN kappa<0.2 THEN 'slight' WHEN kappa<0.4 THEN 'fair' WHEN kappa<0.6 THEN 'moderate'
  WHEN kappa<0.8 THEN 'substantial' ELSE 'almost perfect' END"""
_WITH_INTERVAL = f"SELECT a.* EXCLUDE (seed), low AS kappa_ci_low, high AS kappa_ci_high, low>={stats.KAPPA_GATE} AS clears_gate, {_BAND} AS kappa_band FROM agreed a JOIN bounds USING (seed)"
_SEEDED_TASKS = f"SELECT concat_ws('|','kappa',task_type) AS seed, * FROM cells WHERE {_N}>=5"


@registered("kappa_ci", o.query(
    _WITH_INTERVAL, "joined", cells=_TASK_CELLS, seeded=_SEEDED_TASKS, **_REDRAWN, agreed=_AGREED_SEEDED.format(by="seed, task_type,")))
def kappa_ci(spark, d):
    """Interval of kappa per task."""
    return ag.kappa_ci(ag.agreement_by_task(_COMPARED(spark, d)), ["task_type"])


@registered("interpret_kappa", o.query(
    """SELECT task_type, kappa, CASE WHEN kappa<0 THEN 'worse than chance' WHEN kappa<0.2 THEN 'slight' WHEN kappa<0.4 THEN 'fair' WHEN kappa<0.6 THEN 'moderate'
       WHEN kappa<0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM ({})""".format(_AGREED.format(by="task_type,")), "joined", cells=_TASK_CELLS))
def interpret_kappa(spark, d):
    rated = ag.agreement(ag.confusion(_COMPARED(spark, d), ["task_type"]), ["task_type"])
    return rated.select("task_type", "kappa", stats.interpret_kappa(F.col("kappa")).alias("band"))


_DIAG = """SELECT count(*) AS n_labelled, count(*) FILTER (status='compared') AS n_compared, count(*) FILTER (status='unparseable') AS n_unparseable, count(*) FILTER (status='missing') AS n_missing,
  count(*) FILTER (outcome IS NOT NULL AND position_flip)/count(*) FILTER (outcome IS NOT NULL)::DOUBLE AS flip_rate, count(*) FILTER (candidate_shown_as='A') AS shown_a, count(*) FILTER (candidate_shown_as='B') AS shown_b,
  """ + ", ".join(f"count(*) FILTER (status='compared' AND human='{k}') AS human_{k}, count(*) FILTER (status='compared' AND outcome='{k}') AS judge_{k}" for k in stats.CLASSES) + """,
  coalesce(floor(quantile_cont(elapsed_ms,0.5) FILTER (elapsed_ms>0))::BIGINT,0) AS median_elapsed_ms FROM joined"""


@registered("judge_diagnostics", o.query(_DIAG, "joined"))
def judge_diagnostics(spark, d):
    return ag.judge_diagnostics(_JOINED(spark, d))


_PROFILE = """SELECT coalesce(sum(n),0)::BIGINT AS disagreements, coalesce(sum(w),0)::BIGINT AS toward_win, coalesce(sum(l),0)::BIGINT AS toward_loss, coalesce(sum(f),0)::BIGINT AS fast, max_by(task_type,(n,task_type)) AS top_task, coalesce(max(n),0) AS top_task_n FROM (
  SELECT task_type, count(*) AS n, count(*) FILTER (outcome='win') AS w, count(*) FILTER (outcome='loss') AS l, count(*) FILTER (elapsed_ms>0 AND elapsed_ms<5000) AS f
  FROM joined WHERE status='compared' AND human<>outcome GROUP BY task_type)"""


@registered("disagreement_profile", o.query(_PROFILE, "joined"))
def disagreement_profile(spark, d):
    return ag.disagreement_profile(_JOINED(spark, d))


_ONE_ROW = dict(
    cells=_CELLS, seeded="SELECT 'kappa' AS seed, * FROM cells", **_REDRAWN, agreed=_AGREED_SEEDED.format(by="seed,"),
    agreed_ci=_WITH_INTERVAL, diagnostics=_DIAG, profile=_PROFILE,
    facts="SELECT *, least(recall_win, recall_tie, recall_loss) AS weakest FROM agreed_ci, diagnostics, profile")
_RULES = [  # finding, condition, subject, value
    ("gate_cleared", "clears_gate", "NULL", "kappa_ci_low"),
    ("gate_not_cleared", "NOT clears_gate", "NULL", "kappa_ci_low"),
    ("tie_happy", "judge_tie>2*greatest(1,human_tie)", "NULL", "judge_tie"),
    ("over_deciding", "human_tie>2*greatest(1,judge_tie)", "NULL", "human_tie"),
    ("position_flips", "flip_rate>0.2", "NULL", "flip_rate"),
    ("favours_candidate", "toward_win>2*greatest(1,toward_loss)", "NULL", "toward_win"),
    ("favours_reference", "toward_loss>2*greatest(1,toward_win)", "NULL", "toward_loss"),
    ("weak_class", "weakest<0.5", "CASE WHEN recall_win=weakest THEN 'win' WHEN recall_tie=weakest THEN 'tie' ELSE 'loss' END", "weakest"),
    ("one_task", "top_task_n>disagreements*0.5", "top_task", "top_task_n"),
    ("fast_labels", "fast>greatest(1,n)*0.15", "NULL", "fast"),
]
_FINDINGS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS finding, CAST({subject} AS VARCHAR) AS subject, ({value})::DOUBLE AS value FROM facts WHERE {applies}"
    for i, (name, applies, subject, value) in enumerate(_RULES, 1))


@registered("diagnose", o.query("SELECT * FROM findings", "joined", **_ONE_ROW, findings=_FINDINGS))
def diagnose(spark, d):
    """Findings about the judge."""
    joined = _JOINED(spark, d)
    agreed = ag.kappa_ci(ag.agreement(ag.confusion(joined.filter("status = 'compared'"))))
    return ag.diagnose(agreed, ag.judge_diagnostics(joined), ag.disagreement_profile(joined))


_FIRST = "SELECT DISTINCT slug, model, text FROM generations WHERE replicate_idx=0"
_SIDES = """SELECT i.slug, i.verifier, i.ground_truth, c.model AS candidate_model, r.model AS reference_model, c.text AS candidate_text, r.text AS reference_text FROM items i
  JOIN firsts c ON c.slug=i.slug AND c.model IN ('m-small','m-mid') JOIN firsts r ON r.slug=i.slug AND r.model='m-large'"""


def _pass(side: str) -> str:
    t = f"{side}_text"
    return (f"CASE verifier WHEN 'final_number' THEN coalesce({NUMBER_SQL.format(t=t)}=try_cast(ground_truth AS DOUBLE),false) "
            f"WHEN 'choice_letter' THEN coalesce({CHOICE_SQL.format(t=t)}=ground_truth,false) END")


_TRUTH = f"SELECT *, CASE WHEN ok THEN 'win' ELSE 'loss' END AS expected FROM (SELECT *, {_pass('candidate')} AS ok, {_pass('reference')} AS ref_ok FROM sides) WHERE ok<>ref_ok"
_CALL = f"CASE WHEN {o.U(chr(39) + 'call' + chr(39), 'slug', 'candidate_model')}<0.8 THEN expected WHEN {o.U(chr(39) + 'call' + chr(39), 'slug', 'candidate_model')}<0.95 THEN 'tie' END"


REPORT = """SELECT a.*, g.*, {findings} AS findings, t.* FROM agreed_ci a, diagnostics g,
       (SELECT count(called) AS ground_truth_n, count(*) FILTER (called=expected)/count(called)::DOUBLE AS ground_truth_accuracy FROM (SELECT *, """ + _CALL + """ AS called FROM truth)) t"""
REPORT_TABLES = ("joined", "items", "generations")
REPORT_CTES = dict(**_ONE_ROW, findings=_FINDINGS, firsts=_FIRST, sides=_SIDES, truth=_TRUTH)


@registered("calibration_report", o.query(
    REPORT.format(findings="(SELECT string_agg(finding, ',' ORDER BY position) FROM findings)"), *REPORT_TABLES, **REPORT_CTES))
def calibration_report(spark, d):
    report = ag.calibration_report(fx.labels(spark, d), fx.judgments(spark, d), _discriminable(spark, d))
    return report.withColumn("findings", F.array_join("findings", ","))


def _compared_texts(spark, d):
    first = fx.generations(spark, d).filter("replicate_idx = 0").select("slug", "model", "text").distinct()
    pairs = fx.items(spark, d).select(
        "slug", "verifier", "ground_truth", F.lit(fx.STRONG).alias("reference_model"),
        F.explode(F.array(F.lit(fx.CHEAP), F.lit(fx.MID))).alias("candidate_model"))
    return ag.candidate_vs_reference(pairs, first)


def _discriminable(spark, d):
    from plumbline.functions.hashing import uniform
    u = uniform(F.lit("call"), F.col("slug"), F.col("candidate_model"))
    return ag.ground_truth_discriminable(_compared_texts(spark, d)).withColumn(
        "outcome", F.when(u < 0.8, F.col("expected")).when(u < 0.95, "tie"))


@registered("candidate_vs_reference", o.query(
    "SELECT slug, candidate_model, candidate_text, reference_text FROM sides", "items", "generations", firsts=_FIRST, sides=_SIDES))
def candidate_vs_reference(spark, d):
    return _compared_texts(spark, d).select("slug", "candidate_model", "candidate_text", "reference_text")


@registered("ground_truth_discriminable", o.query(
    "SELECT slug, candidate_model, ok AS candidate_ok, expected FROM truth", "items", "generations", firsts=_FIRST, sides=_SIDES, truth=_TRUTH))
def ground_truth_discriminable(spark, d):
    return _discriminable(spark, d).select("slug", "candidate_model", "candidate_ok", "expected")


@registered("judge_accuracy", o.query(
    f"""SELECT candidate_model, count(called) AS n, count(*) FILTER (called=expected) AS correct, count(*) FILTER (called=expected)/count(called)::DOUBLE AS accuracy
        FROM (SELECT *, {_CALL} AS called FROM truth) GROUP BY candidate_model""", "items", "generations", firsts=_FIRST, sides=_SIDES, truth=_TRUTH))
def judge_accuracy(spark, d):
    return ag.judge_accuracy(_discriminable(spark, d), ["candidate_model"])
