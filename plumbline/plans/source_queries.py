"""Sources and sinks: strict JSON, stores, trace tables, reports, dataset adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import corpus, costing
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.registry import registered
from plumbline.session import shared_dir
from plumbline.sources import adapters, files


@registered("corpus_roundtrip", o.query(
    "SELECT slug, task_type, split, verifiable, ground_truth, verifier, prompt AS content, 'user' AS role FROM items", "items"))
def corpus_roundtrip(spark, d):
    path = shared_dir(spark, "corpus")
    items = fx.items(spark, d)
    files.write_sorted_json(items.select(
        "slug", "task_type", "split", "verifiable", "ground_truth", "verifier", F.lit("orders").alias("source_dataset"),
        F.col("key").cast("string").alias("source_id"), F.lit("CC0").alias("source_license"),
        F.array(F.struct(F.col("prompt").alias("content"), F.lit("user").alias("role"))).alias("messages")), path)
    read = files.read_corpus(spark, path)
    return read.select("slug", "task_type", "split", "verifiable", "ground_truth", "verifier", F.inline("messages"))


@registered("labels_last_wins", o.query(
    """SELECT pair_id, max_by(human, labeled_at) AS label, max(labeled_at) AS labeled_at, count(*) AS n FROM (
       SELECT pair_id, CASE WHEN k=0 THEN human ELSE 'tie' END AS human, '2024-01-0'||(1+(doc_id+k)%3) AS labeled_at FROM labelled, (VALUES (0),(1)) t(k)) GROUP BY pair_id""", "labelled").replace(", count(*) AS n FROM (", " FROM ("))
def labels_last_wins(spark, d):
    """Each pair is labelled twice; the later line counts."""
    path = shared_dir(spark, "labels")
    log = fx.labels(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    files.write_sorted_json(log.select(
        "pair_id", F.col("pair_id").alias("slug"), "task_type", F.lit("m").alias("candidate_model"), F.lit("p").alias("labeler"), "elapsed_ms",
        F.when(F.col("k") == 0, F.col("human")).otherwise("tie").alias("outcome"),
        F.concat(F.lit("2024-01-0"), 1 + (F.col("doc_id") + F.col("k")) % 3).alias("labeled_at")), path)
    return files.read_labels(spark, path).select("pair_id", F.col("outcome").alias("label"), "labeled_at")


@registered("pairs_roundtrip", o.query("SELECT 'pair-'||doc_id AS pair_id, text AS left_text, 'different' AS label, (doc_id%10)/10.0::DOUBLE AS similarity FROM documents"))
def pairs_roundtrip(spark, d):
    """Whole texts through JSON lines and back; a missing folder adds nothing."""
    path = shared_dir(spark, "pairs")
    docs = fx.load(spark, d, "documents")
    files.write_sorted_json(docs.select(
        F.concat(F.lit("pair-"), "doc_id").alias("pair_id"), F.lit("different").alias("label"), F.col("source").alias("left_slug"), "source",
        F.col("lang").alias("right_slug"), F.col("text").alias("left_text"), F.lit("").alias("right_text"),
        ((F.col("doc_id") % 10) / F.lit(10.0)).alias("similarity"), F.lit(False).alias("human_verified")), path)
    both = files.read_pairs(spark, path).unionByName(files.read_pairs(spark, path + "-absent"))
    return both.select("pair_id", "left_text", "label", "similarity")


@registered("records_roundtrip", o.query("SELECT slug, task_type, split, model, success, cost_nano, agreement, verifier_confidence FROM records", "records"))
def records_roundtrip(spark, d):
    path = shared_dir(spark, "records")
    files.write_records(fx.records_long(spark, d), path)
    return files.read_records(spark, path)


@registered("generation_store", o.query(
    """SELECT model, count(*) AS stored, sum(output_tokens)::BIGINT AS output_tokens, (SELECT count(DISTINCT slug||model||'|'||replicate_idx//2) FROM generations g2 WHERE replicate_idx%2=1 AND g2.model=f.model
         AND slug||model||'|'||replicate_idx//2 NOT IN (SELECT slug||model||'|'||part FROM firsts)) AS missing FROM firsts f GROUP BY model""", "generations",
    firsts="SELECT DISTINCT slug, model, replicate_idx//2 AS part, text, output_tokens FROM generations WHERE replicate_idx%2=0"))
def generation_store(spark, d):
    """Samples come in twos: the first of each goes into the store twice, and the second time nothing is added; the second is looked up."""
    keyed = fx.generations(spark, d).withColumn("cache_key", F.sha2(F.concat("slug", "model", F.lit("|"), F.floor(F.col("replicate_idx") / 2)), 256))
    store = files.KeyedStore(spark, shared_dir(spark, "generations"), "cache_key string, model string, text string, output_tokens bigint")
    firsts = keyed.filter("replicate_idx % 2 = 0").select("cache_key", "model", "text", F.col("output_tokens").cast("bigint").alias("output_tokens"))
    store.put(firsts)
    store.put(firsts)
    held = store.table().groupBy("model").agg(F.count(F.lit(1)).alias("stored"), F.sum("output_tokens").alias("output_tokens"))
    wanted = keyed.filter("replicate_idx % 2 = 1").select("cache_key", "model")
    lost = store.missing(wanted, once=True).groupBy("model").agg(F.count(F.lit(1)).alias("missing"))
    return held.join(lost, "model", "left").select("model", "stored", "output_tokens", F.coalesce("missing", F.lit(0)).alias("missing"))


def letter_profile(texts):
    """A stand-in for an embedding model: length and three letter counts."""
    return [[len(t), t.count("e"), t.count("a"), t.count("\n")] for t in texts]


@registered("embed_all", o.query(
    """SELECT 'doc-'||doc_id AS key, length(text)::DOUBLE AS a, (length(text)-length(replace(text,'e','')))::DOUBLE AS b, (length(text)-length(replace(text,'a','')))::DOUBLE AS c,
       (length(text)-length(replace(text,chr(10),'')))::DOUBLE AS d FROM documents"""))
def embed_all(spark, d):
    """Embed every document through a user function; copies once, and through the store."""
    store = files.KeyedStore(spark, shared_dir(spark, "embeddings"), "cache_key string, vec array<float>")
    texts = fx.load(spark, d, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("key"), "text", text.text_hash(F.lit("letters"), F.col("text")).alias("text_hash"))
    embedded = files.embed_all(texts, letter_profile, 4, store)
    return embedded.select("key", *[F.col("vec")[i].cast("double").alias(n) for i, n in enumerate("abcd")])


@registered("trace_table", o.query("SELECT created_at::DATE AS date, model_served, count(*) AS rows, sum(cost_nano)::BIGINT AS cost_nano FROM traces GROUP BY ALL", "traces"))
def trace_table(spark, d):
    path = shared_dir(spark, "traces")
    files.append_traces(fx.traces(spark, d), path)
    return spark.read.parquet(path).groupBy("date", "model_served").agg(F.count(F.lit(1)).alias("rows"), F.sum("cost_nano").alias("cost_nano"))


@registered("write_report", o.query(
    """SELECT '{"all_models_failed":'||f||',"all_models_passed":'||p||',"artifact_version":1,"kind":"pilot","models_disagreed":'||x||',"seed":20260915}' AS value FROM (
       SELECT count(*) FILTER (a) AS p, count(*) FILTER (NOT a AND b) AS x, count(*) FILTER (NOT b) AS f FROM (SELECT slug, bool_and(passed) AS a, bool_or(passed) AS b FROM pilot GROUP BY slug))""", "pilot"))
def write_report(spark, d):
    path = shared_dir(spark, "report")
    files.write_report(corpus.item_outcomes(fx.pilot(spark, d)), "pilot", path, provenance={"seed": 20260915})
    return spark.read.text(path)


@registered("run_report", o.query(
    """SELECT model, '{"artifact_version":1,"calls":'||calls||',"cost_nano":'||cost||',"kind":"run","model":"'||model||'"}' AS value FROM (
       SELECT model, count(*) AS calls, sum(CASE WHEN from_cache THEN 0 ELSE cost_nano END)::BIGINT AS cost FROM outcomes GROUP BY model)""", "outcomes"))
def run_report(spark, d):
    summary = costing.run_summary(fx.outcomes(spark, d)).select("model", F.col("calls_attempted").alias("calls"), "cost_nano")
    json = files.report_json(summary, "run")
    return json.select(F.get_json_object("value", "$.model").alias("model"), "value")


def _docs(spark, d):
    return fx.load(spark, d, "documents")



def _shown(items):
    return items.select("source_dataset", "source_license", "task_type", "source_id", "ground_truth", F.element_at("messages", 2)["content"].alias("content"))


def _lit(kind: str) -> str:
    dataset, licence, task = adapters.DATASETS[kind]
    return f"'{dataset}' AS source_dataset, '{licence}' AS source_license, '{task}' AS task_type"


_GSM = "CASE WHEN doc_id%3=0 THEN 'so #### '||doc_id||',000 and #### 7' WHEN doc_id%3=1 THEN 'it is ####-'||doc_id||'.5' ELSE 'no answer' END"


@registered("source_gsm8k", o.query(
    f"""SELECT {_lit('gsm8k')}, 'test-'||doc_id AS source_id, replace(regexp_extract(ans,'####\\s*(-?[\\d,]+(?:\\.\\d+)?)',1),',','') AS ground_truth, text AS content FROM (
        SELECT doc_id, text, {_GSM} AS ans FROM documents) WHERE regexp_matches(ans,'####\\s*(-?[\\d,]+(?:\\.\\d+)?)')"""))
def source_gsm8k(spark, d):
    i = F.col("doc_id")
    answer = F.when(i % 3 == 0, F.concat(F.lit("so #### "), i, F.lit(",000 and #### 7"))).when(i % 3 == 1, F.concat(F.lit("it is ####-"), i, F.lit(".5"))).otherwise("no answer")
    return _shown(adapters.normalise_source(_docs(spark, d).select(i.alias("row"), F.col("text").alias("question"), answer.alias("answer")), "gsm8k"))


@registered("source_math", o.query(
    f"""SELECT {_lit('math')}, 'u'||doc_id AS source_id, replace(ans,',','') AS ground_truth, text AS content FROM (
        SELECT doc_id, text, (1+doc_id%5) AS lvl, replace(replace(trim(CASE doc_id%4 WHEN 0 THEN ' '||doc_id||'\\!,500 ' WHEN 1 THEN doc_id||'.25' WHEN 2 THEN '\\frac{{1}}{{'||doc_id||'}}' ELSE '-'||doc_id END),'\\!',''),'\\,','') AS ans FROM documents)
        WHERE lvl>=3 AND regexp_matches(ans,'^-?\\d[\\d,]*(?:\\.\\d+)?$')"""))
def source_math(spark, d):
    i = F.col("doc_id")
    answer = (F.when(i % 4 == 0, F.concat(F.lit(" "), i, F.lit("\\!,500 "))).when(i % 4 == 1, F.concat(i, F.lit(".25")))
              .when(i % 4 == 2, F.concat(F.lit("\\frac{1}{"), i, F.lit("}"))).otherwise(F.concat(F.lit("-"), i)))
    rows = _docs(spark, d).select(F.concat(F.lit("u"), i).alias("unique_id"), F.col("text").alias("problem"), (1 + i % 5).cast("string").alias("level"), answer.alias("answer"))
    return _shown(adapters.normalise_source(rows, "math"))


@registered("source_mmlu_pro", o.query(
    f"""SELECT {_lit('mmlu_pro')}, doc_id::VARCHAR AS source_id, chr((65+doc_id%3)::INT) AS ground_truth, text||chr(10)||chr(10)||'A. '||lang||chr(10)||'B. '||source||chr(10)||'C. none' AS content FROM documents"""))
def source_mmlu_pro(spark, d):
    rows = _docs(spark, d).select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("question"), F.array("lang", "source", F.lit("none")).alias("options"),
        F.concat(F.lit(" "), F.lower(F.char(F.lit(65) + F.col("doc_id") % 3))).alias("answer"))
    return _shown(adapters.normalise_source(rows, "mmlu_pro"))


@registered("source_cnn", o.query(f"SELECT {_lit('cnn')}, doc_id::VARCHAR AS source_id, NULL::VARCHAR AS ground_truth, text AS content FROM documents WHERE length(text) BETWEEN 1500 AND 6000"))
def source_cnn(spark, d):
    return _shown(adapters.normalise_source(_docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("article")), "cnn"))


@registered("source_dolly", o.query(
    f"""SELECT {_lit('dolly')}, 'train-'||doc_id AS source_id, NULL::VARCHAR AS ground_truth, trim(text) AS content FROM documents WHERE lang IN ('en','fr') AND source<>'src3' AND length(trim(text))>=25"""))
def source_dolly(spark, d):
    category = F.when(F.col("lang") == "en", "open_qa").when(F.col("lang") == "fr", "general_qa").otherwise("closed_qa")
    rows = _docs(spark, d).select(F.col("doc_id").alias("row"), category.alias("category"), F.when(F.col("source") == "src3", "given").alias("context"), F.col("text").alias("instruction"))
    return _shown(adapters.normalise_source(rows, "dolly"))


@registered("source_bitext", o.query(f"SELECT {_lit('bitext')}, 'train-'||doc_id AS source_id, NULL::VARCHAR AS ground_truth, trim(text) AS content FROM documents WHERE length(trim(text))>=20"))
def source_bitext(spark, d):
    return _shown(adapters.normalise_source(_docs(spark, d).select(F.col("doc_id").alias("row"), F.col("text").alias("instruction")), "bitext"))


