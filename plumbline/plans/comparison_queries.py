"""Arms against arms: pairing, tests, intervals, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import pairing, routing
from plumbline.operators.ranking import join_shuffled
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.registry import registered

PAIRS = [(fx.CHEAP, fx.MID), (fx.CHEAP, fx.STRONG), (fx.MID, fx.STRONG)]
_WIDE = """SELECT slug, task_type, split, bool_or(success) FILTER (model='m-small') AS s0, bool_or(success) FILTER (model='m-mid') AS s1,
  bool_or(success) FILTER (model='m-large') AS s2 FROM records GROUP BY ALL"""
_PAIRED = """SELECT slug, task_type, split, 'm-small->m-mid' AS comparison, 'm-small' AS baseline, 'm-mid' AS candidate, s0 AS a, s1 AS b FROM wide
  UNION ALL SELECT slug, task_type, split, 'm-small->m-large', 'm-small', 'm-large', s0, s2 FROM wide
  UNION ALL SELECT slug, task_type, split, 'm-mid->m-large', 'm-mid', 'm-large', s1, s2 FROM wide"""


def _counts(keys: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (NOT a AND NOT b) AS n00, count(*) FILTER (NOT a AND b) AS b,
  count(*) FILTER (a AND NOT b) AS c, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a IS NULL OR b IS NULL) AS missing,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n FROM paired GROUP BY {keys}"""


_KEYS = ["task_type", "comparison", "baseline", "candidate"]


@registered("pair_arms", o.query(
    """SELECT comparison, split, count(*) AS items, count(*) FILTER (a) AS a_ok, count(*) FILTER (b) AS b_ok,
    count(*) FILTER (a IS NULL OR b IS NULL) AS missing FROM paired GROUP BY comparison, split""", "records", wide=_WIDE, paired=_PAIRED))
def pair_arms(spark, d):
    paired = pairing.pair_arms(fx.records_long(spark, d), PAIRS, ["split"])
    return paired.groupBy("comparison", "split").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("a").alias("a_ok"), F.count_if("b").alias("b_ok"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"))


@registered("pair_samples", o.query(
    """SELECT comparison, count(*) AS items, count(*) FILTER (a IS NULL OR b IS NULL) AS missing FROM paired GROUP BY comparison""",
    "generations",
    wide="""SELECT slug, bool_or(output_tokens>200) FILTER (model='m-small') AS s0, bool_or(output_tokens>200) FILTER (model='m-large') AS s2
      FROM generations WHERE replicate_idx=0 GROUP BY slug""",
    paired="SELECT slug, 'm-small->m-large' AS comparison, s0 AS a, s2 AS b FROM wide"))
def pair_samples(spark, d):
    first = fx.generations(spark, d).filter("replicate_idx = 0").withColumn("success", F.col("output_tokens") > 200)
    paired = pairing.pair_arms(first, [(fx.CHEAP, fx.STRONG)])
    return paired.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"))


@registered("contingency", o.query("SELECT * FROM counts", "records", wide=_WIDE, paired=_PAIRED,
                                   counts=_counts("task_type, split, comparison")))
def contingency(spark, d):
    paired = pairing.pair_arms(fx.records_long(spark, d), PAIRS, ["task_type", "split"])
    return pairing.contingency(paired, ["task_type", "split", "comparison"])


_COMPARE = """SELECT task_type, comparison, baseline, candidate, n00, c.b, c.c, n11, missing, c.n, (c.b-c.c)/c.n::DOUBLE AS effect,
  low/c.n::DOUBLE AS ci_low, high/c.n::DOUBLE AS ci_high, {outcome} AS outcome, (low>0 OR high<0) AS significant,
  {half} AS detectable_effect, {half}<=0.03 AS can_show_equivalence, {p} AS mcnemar_p,
  CASE WHEN c.b+c.c<25 THEN 'exact' ELSE 'chi2' END AS mcnemar_method, c.b+c.c AS n_discordant, n00+n11 AS n_concordant,
  (c.c+n11)/c.n::DOUBLE AS baseline_rate, (c.b+n11)/c.n::DOUBLE AS candidate_rate
  FROM counts c JOIN bounds USING (task_type, comparison, baseline, candidate)""".format(
    outcome=o.outcome("round_even(low/c.n::DOUBLE,6)", "round_even(high/c.n::DOUBLE,6)"),
    half="round_even((round_even(high/c.n::DOUBLE,6)-round_even(low/c.n::DOUBLE,6))/2.0,6)", p=o.mcnemar_p("c.b", "c.c"))


@registered("compare_runs", o.query(_COMPARE, "records", wide=_WIDE, paired=_PAIRED, counts=_counts(", ".join(_KEYS)),
                                    **o.interval_ctes("counts", _KEYS)))
def compare_runs(spark, d):
    """Every pair of arms on every task, with interval, test and outcome, in one job."""
    return pairing.compare_runs(fx.records_long(spark, d), PAIRS, ["task_type"])


@registered("paired_interval", o.query(
    "SELECT split, comparison, n, c.b, c.c, low, high FROM counts c JOIN bounds USING (split, comparison)",
    "records", wide=_WIDE, paired=_PAIRED, counts=_counts("split, comparison"), **o.interval_ctes("counts", ["split", "comparison"])))
def paired_interval(spark, d):
    counts = pairing.contingency(pairing.pair_arms(fx.records_long(spark, d), PAIRS, ["split"]), ["split", "comparison"])
    ci = stats.paired_interval(F.col("n"), F.col("b"), F.col("c"))
    return counts.withColumn("_ci", ci).select("split", "comparison", "n", "b", "c", "_ci.low", "_ci.high")


@registered("rate_interval", o.query(
    "SELECT task_type, split, model, n, c.b AS k, low, high FROM counts c JOIN bounds USING (task_type, split, model)", "records",
    counts="SELECT task_type, split, model, count(*) AS n, count(*) FILTER (success) AS b, 0::BIGINT AS c FROM records GROUP BY ALL",
    **o.interval_ctes("counts", ["task_type", "split", "model"], resamples=4000)))
def rate_interval(spark, d):
    counts = fx.records_long(spark, d).groupBy("task_type", "split", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("k"))
    ci = stats.rate_interval(F.col("k"), F.col("n"))
    return counts.withColumn("_ci", ci).select("task_type", "split", "model", "n", "k", "_ci.low", "_ci.high")


_DAY = """SELECT o_orderdate AS day, s.comparison, count(*) FILTER (b AND NOT a) AS b, count(*) FILTER (a AND NOT b) AS c
  FROM paired s JOIN orders ON s.slug='item-'||o_orderkey GROUP BY ALL"""


@registered("mcnemar", o.query(
    f"SELECT day, comparison, b, c, {o.mcnemar_p('b', 'c')} AS p_value, CASE WHEN b+c<25 THEN 'exact' ELSE 'chi2' END AS method FROM counts",
    "records", wide=_WIDE, paired=_PAIRED, counts=_DAY))
def mcnemar(spark, d):
    """One test per pair of arms and order day: many small tables, mostly in the exact range."""
    days = fx.load(spark, d, "orders").select(
        F.concat(F.lit("item-"), F.col("o_orderkey")).alias("slug"), F.col("o_orderdate").alias("day"))
    paired = join_shuffled(pairing.pair_arms(fx.records_long(spark, d), PAIRS), days, "slug")
    counts = pairing.contingency(paired, ["day", "comparison"])
    b, c = F.col("b"), F.col("c")
    return counts.select("day", "comparison", "b", "c", F.round(stats.mcnemar_p(b, c), 8).alias("p_value"),
                         stats.mcnemar_method(b, c).alias("method"))


@registered("bh_qvalues", o.query(
    """SELECT task_type, comparison, p_value, family_size, round(least(1.0, min(p_value*family_size/rk) OVER
      (PARTITION BY comparison ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)),8) AS q_value FROM (
      SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p_value, task_type) AS rk, count(*) OVER (PARTITION BY comparison) AS family_size FROM tests)""",
    "records", wide=_WIDE, paired=_PAIRED, counts=_counts("task_type, comparison"),
    tests=f"SELECT task_type, comparison, {o.mcnemar_p('b', 'c')} AS p_value FROM counts"))
def bh_qvalues(spark, d):
    tests = pairing.compare_runs(fx.records_long(spark, d), PAIRS, ["task_type"]).select(
        "task_type", "comparison", F.col("mcnemar_p").alias("p_value"))
    return pairing.bh_qvalues(tests, ["comparison"])


_PLAN = f"z2*0.25/((p-0.5)*(p-0.5))/rate"


@registered("required_items", o.query(
    f"""SELECT comparison, n, rate AS discordant_rate, CASE WHEN p>=1.0 THEN 0 ELSE ceil({_PLAN})::BIGINT END AS required_items FROM (
      SELECT *, {(stats.Z_ALPHA_HALF + stats.Z_POWER_80) ** 2!r}::DOUBLE AS z2, 0.5+0.02::DOUBLE/(2.0*rate) AS p FROM (
      SELECT comparison, n, (b+c)/n::DOUBLE AS rate FROM counts))""", "records", wide=_WIDE, paired=_PAIRED, counts=_counts("comparison")))
def required_items(spark, d):
    counts = pairing.contingency(pairing.pair_arms(fx.records_long(spark, d), PAIRS), ["comparison"])
    return pairing.required_items_per_comparison(counts, 0.02).select("comparison", "n", "discordant_rate", "required_items")


_B = 100


@registered("poisson_bootstrap", o.query(
    """SELECT split, model, n, total/n::DOUBLE AS mean, list_sort(means)[3] AS ci_low, list_sort(means)[98] AS ci_high FROM point JOIN
      (SELECT split, model, list(s/w::DOUBLE) AS means FROM sums GROUP BY ALL) USING (split, model)""",
    "records",
    scores="SELECT slug, split, model, (cost_nano//1000000)::BIGINT AS v FROM records",
    digests=f"SELECT split, model, v, blk, md5(concat_ws('|','7',slug,blk)) AS h FROM scores, range({_B // 4}) r(blk)",
    lanes="SELECT split, model, v, blk, lane, ('0x'||substr(h,1+8*lane,8))::BIGINT AS u FROM digests, range(4) l(lane)",
    sums=f"SELECT split, model, blk*4+lane AS r, sum({o.poisson('u')}) AS w, sum({o.poisson('u')}*v) AS s FROM lanes GROUP BY ALL",
    point="SELECT split, model, count(*) AS n, sum(v) AS total FROM scores GROUP BY ALL"))
def poisson_bootstrap(spark, d):
    """Interval of a mean that is not a pass rate: cost of every arm in milli-dollars."""
    scores = fx.records_long(spark, d).select(
        "slug", "split", "model", F.floor(F.col("cost_nano") / 1000000).alias("milli"))
    return pairing.poisson_bootstrap(scores, ["split", "model"], "slug", "milli", 7, _B)


@registered("classify_intervals", o.query(
    f"SELECT task_type, model, {o.outcome('low', 'high')} AS outcome FROM (SELECT task_type, model, k/n::DOUBLE-0.80-0.02 AS low, k/n::DOUBLE-0.80+0.02 AS high FROM rates)",
    "records", rates="SELECT task_type, model, count(*) AS n, count(*) FILTER (success) AS k FROM records GROUP BY ALL"))
def classify_intervals(spark, d):
    rates = fx.records_long(spark, d).groupBy("task_type", "model").agg(
        (F.count_if("success") / F.count(F.lit(1)) - 0.80).alias("gap"))
    return rates.select("task_type", "model", stats.classify_interval(F.col("gap") - 0.02, F.col("gap") + 0.02, 0.03).alias("outcome"))


@registered("graded_comparison", o.query(
    """SELECT comparison, task_type, n00, b, c, n11, n, missing FROM counts""", "generations", "items",
    graded="""SELECT g.slug, g.model, i.task_type, i.verifier IS NOT NULL AS gradable, CASE i.verifier
        WHEN 'final_number' THEN coalesce(try_cast(replace(coalesce(list_last(regexp_extract_all(regexp_replace(g.text,
          '(?is)^.*(?:####|final answer\\s*(?:is)?\\s*:?|answer\\s*(?:is)?\\s*:?|\\\\boxed\\{)',''), '-?\\d[\\d,]*(?:\\.\\d+)?')),
          list_last(regexp_extract_all(g.text, '-?\\d[\\d,]*(?:\\.\\d+)?'))), ',', '') AS DOUBLE) = i.ground_truth::DOUBLE, false)
        WHEN 'choice_letter' THEN coalesce(upper(coalesce(list_last(regexp_extract_all(g.text,
          '(?i)(?:answer\\s*(?:is)?\\s*:?|option\\s*:?|\\\\boxed\\{|####)\\s*\\(?([A-J])\\)?\\b', 1)),
          list_last(regexp_extract_all(g.text, '\\b\\(?([A-J])\\)?\\b', 1)))) = i.ground_truth, false) END AS success
      FROM generations g JOIN (SELECT *, CASE WHEN verifier IS NOT NULL THEN ground_truth END AS gt FROM items) i ON g.slug=i.slug AND g.replicate_idx=0""",
    records="SELECT slug, task_type, NULL AS split, model, success FROM graded WHERE gradable", wide=_WIDE, paired=_PAIRED, counts=_counts("task_type, comparison")))
def graded_comparison(spark, d):
    """Raw texts to a table of counts: grade, pair, tabulate."""
    first = fx.generations(spark, d).filter("replicate_idx = 0")
    graded = pairing.grade_generations(routing.gradable(fx.items(spark, d)), first)
    scored = graded.withColumnRenamed("passed", "success")
    paired = pairing.pair_arms(scored, PAIRS, ["task_type"])
    return pairing.contingency(paired, ["task_type", "comparison"])


@registered("bh_by_day", o.query(
    """SELECT day, comparison, p_value, family_size, CASE WHEN p_value IS NOT NULL THEN round(least(1.0, min(p_value*family_size/rk) OVER
      (PARTITION BY comparison ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)),8) END AS q_value FROM (
      SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p_value NULLS LAST, day) AS rk, count(p_value) OVER (PARTITION BY comparison) AS family_size FROM tests)""",
    "records", wide=_WIDE, paired=_PAIRED, counts=_DAY,
    tests=f"SELECT day, comparison, CASE WHEN b+c>0 THEN {o.mcnemar_p('b', 'c')} END AS p_value FROM counts"))
def bh_by_day(spark, d):
    """Families of one test a day, many of them tied at 1, ranked in four ranges; days without a discordant pair have no test."""
    tests = mcnemar(spark, d).select("day", "comparison", F.when(F.col("b") + F.col("c") > 0, F.col("p_value")).alias("p_value"))
    return pairing.bh_qvalues(tests, ["comparison"], slices=4)
