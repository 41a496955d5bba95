"""Corpus building over documents, orders and pilot results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import corpus, rules
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.registry import registered

SEED = 20260915


@registered("admission_filters", o.query(
    """SELECT doc_id, n_chars BETWEEN 1500 AND 6000 AS in_band, n_chars>=25 AS long_enough, coalesce(try_cast(lvl AS INT)>=3,false) AS hard, regexp_matches(ans,'^-?\\d[\\d,]*(?:\\.\\d+)?$') AS plain, ans FROM (
       SELECT doc_id, length(text) AS n_chars, CASE WHEN doc_id%7=0 THEN 'x' ELSE (doc_id%6)::VARCHAR END AS lvl,
       replace(replace(trim(CASE doc_id%4 WHEN 0 THEN ' '||doc_id||'\\!,5 ' WHEN 1 THEN doc_id||'.25' WHEN 2 THEN '\\frac{1}{'||doc_id||'}' ELSE doc_id||'\\,000' END),'\\!',''),'\\,','') AS ans FROM documents)"""))
def admission_filters(spark, d):
    i = F.col("doc_id")
    level = F.when(i % 7 == 0, "x").otherwise((i % 6).cast("string"))
    answer = (F.when(i % 4 == 0, F.concat(F.lit(" "), i, F.lit("\\!,5 "))).when(i % 4 == 1, F.concat(i, F.lit(".25")))
              .when(i % 4 == 2, F.concat(F.lit("\\frac{1}{"), i, F.lit("}"))).otherwise(F.concat(i, F.lit("\\,000"))))
    stripped = corpus.strip_tex_spacing(answer)
    return fx.load(spark, d, "documents").select(
        "doc_id", corpus.length_band(F.col("text"), 1500, 6000).alias("in_band"), corpus.min_length(F.col("text"), 25).alias("long_enough"),
        corpus.min_level(level, 3).alias("hard"), corpus.plain_number(stripped).alias("plain"), stripped.alias("ans"))


_DEDUPED = "SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rk FROM raw_items) WHERE rk=1"


@registered("dedupe_first", o.query("SELECT source_dataset, source_id, task_type, text FROM uniq", "raw_items", uniq=_DEDUPED))
def dedupe_first(spark, d):
    return corpus.dedupe_first(fx.raw_items(spark, d), F.col("text"), ["doc_id"]).select("source_dataset", "source_id", "task_type", "text")


def _rank(seed: str, strata: str, key: str) -> str:
    return f"row_number() OVER (PARTITION BY {strata} ORDER BY {o.U(seed, strata, key)}, {key})"


@registered("hash_rank", o.query(
    f"SELECT source_id, task_type, {_rank('11', 'task_type', 'source_id')} AS draw_rank, count(*) OVER (PARTITION BY task_type) AS stratum_size FROM raw_items", "raw_items"))
def hash_rank(spark, d):
    from plumbline.operators.ranking import hash_rank as rank
    return rank(fx.raw_items(spark, d), ["task_type"], 11, "source_id").select("source_id", "task_type", "draw_rank", "stratum_size")


@registered("stratified_sample", o.query(
    f"""SELECT source_id, task_type FROM (SELECT *, {_rank('3', 'task_type', 'source_id')} AS rk FROM raw_items)
        WHERE rk<=greatest(1,200//(SELECT count(DISTINCT task_type) FROM raw_items)) ORDER BY task_type, rk LIMIT 200""", "raw_items"))
def stratified_sample(spark, d):
    """A pilot sample: as many rows of every task, 200 in all."""
    return corpus.stratified_sample(fx.raw_items(spark, d), ["task_type"], 200, 3, "source_id").select("source_id", "task_type")


@registered("label_pairs", o.query(
    f"""SELECT pair_id, slug, task_type, candidate_model, 'm-large' AS reference_model, CASE WHEN {o.U('5', 'slug', 'candidate_model')}<0.5 THEN 'A' ELSE 'B' END AS candidate_shown_as FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_type, candidate_model ORDER BY {o.U('5', 'task_type', 'candidate_model', 'slug')}, slug) AS rk FROM cells)
        WHERE rk<=greatest(1,120//(SELECT count(*) FROM (SELECT DISTINCT task_type, candidate_model FROM cells))) ORDER BY task_type, candidate_model, rk LIMIT 120)
        ORDER BY md5(concat_ws('|','5:pairs',pair_id)), pair_id LIMIT 120""", "items",
    cells="SELECT slug, task_type, m AS candidate_model, slug||'|'||m AS pair_id FROM items, (VALUES ('m-small'),('m-mid')) t(m) WHERE NOT verifiable"))
def label_pairs(spark, d):
    free = fx.items(spark, d).filter("NOT verifiable")
    return corpus.label_pairs(free, [fx.CHEAP, fx.MID], fx.STRONG, 120, 5)


_CUT = """CASE WHEN {r}<=floor({n}*0.2::DOUBLE)+({n}-floor({n}*0.2::DOUBLE)-floor({n}*0.3::DOUBLE)-floor({n}*0.5::DOUBLE)>0)::INT THEN 'calibration'
  WHEN {r}<=floor({n}*0.2::DOUBLE)+floor({n}*0.3::DOUBLE)+({n}-floor({n}*0.2::DOUBLE)-floor({n}*0.3::DOUBLE)-floor({n}*0.5::DOUBLE)>0)::INT+({n}-floor({n}*0.2::DOUBLE)-floor({n}*0.3::DOUBLE)-floor({n}*0.5::DOUBLE)>1)::INT THEN 'dev' ELSE 'test' END"""


@registered("assign_splits", o.query(
    f"SELECT slug, task_type, {_CUT.format(r='r', n='n')} AS split FROM (SELECT slug, task_type, {_rank('17', 'task_type', 'slug')} AS r, count(*) OVER (PARTITION BY task_type) AS n FROM items)", "items"))
def assign_splits(spark, d):
    return corpus.assign_splits(fx.items(spark, d).select("slug", "task_type"), ["task_type"], 17, "slug")


_POOL = "SELECT task_type, 'orders' AS source_dataset, key::VARCHAR AS source_id, ground_truth, 'orders|'||key AS k FROM items"
_TARGETS = {"math_word_problem": 150, "multiple_choice": 120, "summarization": 90, "long_form_qa": 75, "support_reply": 60}
_DRAWN = f"""SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY {o.U(str(SEED), 'task_type', 'k')}, k) AS r FROM pool"""
_PICKED = "SELECT * FROM drawn WHERE r<=CASE task_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in _TARGETS.items()) + " END"
_BUILT = f"""SELECT printf('%s-%04d', task_type, r-1) AS slug, task_type, source_id, {_CUT.format(r='r2', n='n')} AS split, ground_truth IS NOT NULL AS verifiable,
  CASE task_type WHEN 'math_word_problem' THEN 'final_number' WHEN 'multiple_choice' THEN 'choice_letter' END AS verifier FROM (
  SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY {o.U(str(SEED + 1), 'task_type', 'k')}, k) AS r2, count(*) OVER (PARTITION BY task_type) AS n FROM picked)"""


def _pool(spark, d):
    return fx.items(spark, d).select("task_type", F.lit("orders").alias("source_dataset"), F.col("key").cast("string").alias("source_id"), "ground_truth", "prompt")


@registered("build_corpus", o.query("SELECT * FROM built", "items", pool=_POOL, drawn=_DRAWN, picked=_PICKED, built=_BUILT))
def build_corpus(spark, d):
    """A benchmark of fixed size per task, drawn from all candidates."""
    return corpus.build_corpus(_pool(spark, d), _TARGETS, SEED).select("slug", "task_type", "source_id", "split", "verifiable", "verifier")


@registered("corpus_profile", o.query(
    "SELECT task_type, split, count(*) AS items, count(ground_truth) AS gradable FROM items GROUP BY GROUPING SETS ((task_type),(split),())", "items"))
def corpus_profile(spark, d):
    return corpus.corpus_profile(fx.items(spark, d))


@registered("pass_rates", o.query(
    "SELECT model, task_type, count(*) AS n, count(*) FILTER (passed) AS passes, count(*) FILTER (passed)/count(*)::DOUBLE AS pass_rate FROM pilot GROUP BY GROUPING SETS ((model),(model,task_type))", "pilot"))
def pass_rates(spark, d):
    return corpus.pass_rates(fx.pilot(spark, d))


_PER = "SELECT slug, max(task_type) AS task_type, count(*) AS results, bool_and(passed) AS all_p, bool_or(passed) AS any_p FROM pilot GROUP BY slug"


@registered("item_outcomes", o.query(
    "SELECT count(*) FILTER (all_p) AS all_models_passed, count(*) FILTER (NOT all_p AND any_p) AS models_disagreed, count(*) FILTER (NOT any_p) AS all_models_failed FROM per", "pilot", per=_PER))
def item_outcomes(spark, d):
    return corpus.item_outcomes(fx.pilot(spark, d))


@registered("discriminative_items", o.query("SELECT slug, task_type FROM per WHERE results>=2 AND NOT all_p AND any_p", "pilot", per=_PER))
def discriminative_items(spark, d):
    return corpus.discriminative_items(fx.pilot(spark, d))


@registered("drop_easy_items", o.query("SELECT slug, task_type FROM per WHERE results>=2 AND NOT all_p", "pilot", per=_PER))
def drop_easy_items(spark, d):
    return corpus.discriminative_items(fx.pilot(spark, d), mode="drop_easy")



@registered("filter_by_difficulty", o.query(
    "SELECT i.slug, i.task_type, i.split FROM items i LEFT JOIN per p USING (slug) WHERE ground_truth IS NULL OR p.slug IS NULL OR (results>=2 AND NOT all_p AND any_p)", "items",
    pilot="SELECT 'item-'||(l_orderkey) AS slug, CASE l_linenumber%2 WHEN 0 THEN 'a' ELSE 'b' END AS model, l_quantity>20 AS passed, 'x' AS task_type FROM lineitem", per=_PER))
def filter_by_difficulty(spark, d):
    """Pilot results read off lineitem, so a part of the items was never piloted."""
    pilot = fx.load(spark, d, "lineitem").select(
        F.concat(F.lit("item-"), F.col("l_orderkey")).alias("slug"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("model"),
        (F.col("l_quantity") > 20).alias("passed"), F.lit("x").alias("task_type"))
    return corpus.filter_by_difficulty(fx.items(spark, d), pilot).select("slug", "task_type", "split")


@registered("difficulty_report", o.query(
    """SELECT task_type, count(*) AS piloted, count(*) FILTER (results>=2 AND NOT all_p AND any_p) AS kept, count(*) FILTER (NOT (results>=2 AND NOT all_p AND any_p)) AS removed FROM per GROUP BY task_type""", "pilot", per=_PER))
def difficulty_report(spark, d):
    return corpus.difficulty_report(fx.pilot(spark, d))


_DIGEST = """sha256('{"doc_id":'||doc_id||',"lang":'||to_json(lang)||',"n_chars":'||n_chars||',"source":'||to_json(source)||',"text":'||to_json(text)||'}')"""


@registered("fingerprint", o.query(
    """SELECT sha256(string_agg(h,'' ORDER BY p)) AS fingerprint, sum(n)::BIGINT AS rows FROM l1""",
    l3=f"SELECT d AS p, sha256(d||'x'||count(*)) AS h, count(*) AS n FROM (SELECT {_DIGEST} AS d FROM documents) GROUP BY d",
    l2="SELECT substr(p,1,6) AS p, sha256(string_agg(h,'' ORDER BY p)) AS h, sum(n) AS n FROM l3 GROUP BY substr(p,1,6)",
    l1="SELECT substr(p,1,3) AS p, sha256(string_agg(h,'' ORDER BY p)) AS h, sum(n) AS n FROM l2 GROUP BY substr(p,1,3)"))
def fingerprint(spark, d):
    docs = fx.load(spark, d, "documents")
    return corpus.fingerprint(docs, docs.columns)


@registered("item_invariants", o.query(
    """SELECT 'verifiable_without_truth' AS rule, count(*) FILTER (v AND NOT (t IS NOT NULL AND c IS NOT NULL)) AS violations FROM x
       UNION ALL SELECT 'truth_without_verifiable', count(*) FILTER (NOT v AND (t IS NOT NULL OR c IS NOT NULL)) FROM x
       UNION ALL SELECT 'repeated_slug', count(*)-count(DISTINCT slug) FROM x UNION ALL SELECT 'repeated_prompt', count(*)-count(DISTINCT prompt) FROM x""",
    x="""SELECT 's-'||(doc_id - doc_id%2) AS slug, text AS prompt, doc_id%3=0 AS v, CASE WHEN doc_id%5<>0 THEN 't' END AS t, CASE WHEN doc_id%3=0 THEN 'final_number' END AS c FROM documents"""))
def item_invariants(spark, d):
    i = F.col("doc_id")
    return rules.check_item_invariants(fx.load(spark, d, "documents").select(
        F.concat(F.lit("s-"), i - i % 2).alias("slug"), F.col("text").alias("prompt"), (i % 3 == 0).alias("verifiable"),
        F.when(i % 5 != 0, "t").alias("ground_truth"), F.when(i % 3 == 0, "final_number").alias("verifier")))


@registered("audit_uniqueness", o.query("SELECT slug, model, replicate_idx, count(*) AS copies FROM generations GROUP BY ALL HAVING count(*)>1", "generations"))
def audit_uniqueness(spark, d):
    return rules.audit_uniqueness(fx.generations(spark, d), ["slug", "model", "replicate_idx"])


@registered("unlabelled_pairs", o.query(
    "SELECT 'doc-'||doc_id AS pair_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY pair_id LIMIT 50"))
def unlabelled_pairs(spark, d):
    """The next fifty comparisons nobody has labelled yet, in order."""
    docs, done = fx.load(spark, d, "documents").select("doc_id"), fx.load(spark, d, "labels").select("doc_id")
    return docs.join(done, "doc_id", "left_anti").select(F.concat(F.lit("doc-"), "doc_id").alias("pair_id")).orderBy("pair_id").limit(50)


@registered("slug_overlap", o.query("SELECT 'item-'||o_orderkey AS slug FROM orders INTERSECT SELECT 'item-'||l_orderkey FROM lineitem"))
def slug_overlap(spark, d):
    left = fx.items(spark, d).select("slug")
    return left.intersect(fx.load(spark, d, "lineitem").select(F.concat(F.lit("item-"), "l_orderkey").alias("slug")))
