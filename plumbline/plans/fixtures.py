"""Workload tables derived from the given ones, with the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.hashing import uniform

CHEAP, MID, STRONG = "m-small", "m-mid", "m-large"
LADDER = (CHEAP, MID, STRONG)
PASS_RATES = {CHEAP: 0.62, MID: 0.82, STRONG: 0.90}
CATALOG_SCHEMA = (
    "model string, provider string, rung string, input_nano bigint, output_nano bigint, cache_read_nano bigint, "
    "cache_write_nano bigint, max_output_tokens int, supports_sampling_params boolean")
CATALOG = [
    (CHEAP, "alpha", "cheap", 75, 300, None, None, 32768, True),
    (MID, "beta", "mid", 1000, 5000, 100, 1250, 64000, True),
    (STRONG, "beta", "strong", 5000, 25000, 500, 6250, 128000, False),
]
TASKS = {"1": "math_word_problem", "2": "multiple_choice", "3": "summarization", "4": "long_form_qa", "5": "support_reply"}


def load(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A given table, read as it lies."""
    return spark.read.parquet(f"{d}/{table}.parquet")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def _choose(column: Column, table: dict) -> Column:
    out = None
    for key, value in table.items():
        out = (F if out is None else out).when(column == key, F.lit(value))
    return out


def task_of(priority: Column) -> Column:
    return _choose(F.substring(priority, 1, 1), TASKS)


def split_of_key(key: Column) -> Column:
    u = uniform(F.lit("split"), key)
    return F.when(u < 0.2, "calibration").when(u < 0.5, "dev").otherwise("test")


def _models(*fields: tuple[str, dict]) -> Column:
    return F.array(*[
        F.struct(F.lit(m).alias("model"), *[F.lit(table[m]).alias(name) for name, table in fields]) for m in LADDER])


def items(spark: SparkSession, d: str) -> DataFrame:
    """Corpus items from orders: three tasks in five have no ground truth."""
    key = F.col("o_orderkey")
    task = task_of(F.col("o_orderpriority"))
    truth = (
        F.when(task == "math_word_problem", key.cast("string"))
        .when(task == "multiple_choice", F.char(F.lit(65) + key % 10)))
    return load(spark, d, "orders").select(
        F.concat(F.lit("item-"), key).alias("slug"), key.alias("key"), task.alias("task_type"),
        split_of_key(key).alias("split"), truth.alias("ground_truth"),
        F.when(task == "math_word_problem", "final_number").when(task == "multiple_choice", "choice_letter").alias("verifier"),
        truth.isNotNull().alias("verifiable"),
        F.concat(F.lit("Order "), key, F.lit(" of customer "), F.col("o_custkey"), F.lit(" totals "),
                 F.col("o_orderstatus")).alias("prompt"),
        (F.lit(40) + key % 900).alias("prompt_chars"),
    )


def records_long(spark: SparkSession, d: str) -> DataFrame:
    """Evidence per (item, model): shared item difficulty, exact integer costs."""
    key = F.col("o_orderkey")
    price_in = {m: row[3] for m, row in zip(LADDER, CATALOG)}
    price_out = {m: row[4] for m, row in zip(LADDER, CATALOG)}
    rung = {m: i for i, m in enumerate(LADDER)}
    base = load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority",
        F.inline(_models(("p", PASS_RATES), ("p_in", price_in), ("p_out", price_out), ("rung", rung))))
    return base.select(
        F.concat(F.lit("item-"), key).alias("slug"), task_of(F.col("o_orderpriority")).alias("task_type"),
        split_of_key(key).alias("split"), "model", "rung",
        ((uniform(F.lit("ok"), key) < F.col("p")) | (uniform(F.lit("ok"), key, F.col("model")) < F.col("p") / 4)).alias("success"),
        ((100 + key % 900) * F.col("p_in") + (200 + F.col("o_custkey") % 400) * F.col("p_out")).alias("cost_nano"),
        ((F.floor(uniform(F.lit("agree"), key) * 5) + 1) / 5).alias("agreement"),
        (F.floor(uniform(F.lit("check"), key) * 101) / 100).alias("verifier_confidence"),
    )


def pilot(spark: SparkSession, d: str) -> DataFrame:
    return records_long(spark, d).select("slug", "model", F.col("success").alias("passed"), "task_type")


def generations(spark: SparkSession, d: str) -> DataFrame:
    """Samples from lineitem: several per (item, model), some missing, some repeated, in varied wording."""
    key, idx = F.col("l_orderkey"), F.col("l_linenumber") - 1
    base = load(spark, d, "lineitem").select(
        key.alias("key"), idx.alias("replicate_idx"), F.inline(_models(("p", PASS_RATES))))
    base = base.filter(~((F.col("model") == STRONG) & (F.col("key") % 17 == 0)))
    right = uniform(F.lit("gen"), F.col("key"), F.col("model"), F.col("replicate_idx")) < F.col("p")
    form = (F.col("key") + F.col("replicate_idx")) % 5
    number = F.when(right, F.col("key")).otherwise(F.col("key") + 1).cast("string")
    letter = F.char(F.lit(65) + (F.col("key") + F.when(right, 0).otherwise(1)) % 10)
    text = F.when(F.col("key") % 2 == 0, (
        F.when(form == 0, F.concat(F.lit("Work: 3*4=12.\n#### "), number))
        .when(form == 1, F.concat(F.lit("The answer is "), number, F.lit(".00")))
        .when(form == 2, F.concat(F.lit("so therefore "), number))
        .when(form == 3, F.lit("I cannot solve this."))
        .otherwise(F.concat(F.lit("#### $"), number)))).otherwise(
        F.when(form == 0, F.concat(F.lit("The answer is ("), letter, F.lit(")")))
        .when(form == 1, F.concat(F.lit("Answer: "), letter, F.lit(", worth "), number))
        .when(form == 2, F.concat(F.lit("#### "), letter))
        .when(form == 3, F.concat(F.lit("thinking\n"), letter))
        .otherwise(F.concat(F.lit("\\boxed{"), number, F.lit("}"))))
    return base.select(
        F.concat(F.lit("item-"), F.col("key")).alias("slug"), "model", "replicate_idx", text.alias("text"),
        (100 + F.col("key") % 900).alias("input_tokens"),
        (50 + (F.col("key") * 7 + F.col("replicate_idx")) % 400).alias("output_tokens"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Run outcomes from generations: failures, cache hits, unconfirmed usage, latency, grades."""
    gens = generations(spark, d).join(items(spark, d).select("slug", "key", "task_type", "verifier"), "slug")
    u = uniform(F.lit("run"), F.col("slug"), F.col("model"), F.col("replicate_idx"))
    return gens.select(
        "slug", "model", "task_type",
        F.when(u < 0.02, "timeout").when(u < 0.03, "rate_limited").when(u < 0.04, "provider_5xx").alias("error_kind"),
        (u > 0.8).alias("from_cache"), ((F.col("key") % 10) != 0).alias("usage_is_final"), "input_tokens", "output_tokens",
        (F.col("input_tokens") * 75 + F.col("output_tokens") * 300).alias("cost_nano"),
        F.floor(u * 4000).cast("bigint").alias("latency_ms"),
        F.when(F.col("verifier").isNotNull(), (F.col("key") + F.col("replicate_idx")) % 3 > 0).alias("passed"))


def model_of(event_id: Column) -> Column:
    return F.when(event_id % 3 == 0, CHEAP).when(event_id % 3 == 1, MID).otherwise(STRONG)


def trace_columns(events: DataFrame) -> DataFrame:
    """Traces from events, streamed or not."""
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.floor("value").cast("bigint")
    model = model_of(eid)
    prices = {m: (row[3], row[4]) for m, row in zip(LADDER, CATALOG)}
    cost = None
    for m, (a, b) in prices.items():
        cost = (F if cost is None else cost).when(model == m, k * a + out * b)
    is_error = F.col("event_type") == "error"
    latency = (F.floor(F.col("value") * 10) + 50).cast("bigint")
    body = F.concat(F.lit('{"messages":[{"role":"user","content":"'), F.col("event_type"), F.lit(" "), k, F.lit('"}]}'))
    reply = F.when(eid % 4 == 0, F.concat(F.lit('{"choices":[{"message":{"content":"r'), k, F.lit('"}}]}'))).when(
        eid % 4 == 1, F.lit("{}")).otherwise(F.concat(F.lit('{"text":"r'), k, F.lit('"}')))
    return events.select(
        eid.alias("id"), F.concat(F.lit("req-"), (eid - eid % 2)).alias("request_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("route_key"), model.alias("model_served"),
        F.when(eid % 3 == 0, "alpha").otherwise("beta").alias("provider"),
        F.when(is_error, 500).otherwise(200).alias("status"), F.when(is_error, "provider_5xx").alias("error_kind"),
        k.alias("input_tokens"), out.alias("output_tokens"), latency.alias("latency_ms"),
        F.floor(latency / 4).cast("bigint").alias("ttft_ms"), (eid % 10 != 0).alias("usage_is_final"), cost.alias("cost_nano"),
        (F.length("props") * 100 + eid % 700).alias("bytes"), F.lit(1).alias("policy_version"),
        body.alias("request_body"), reply.alias("response_body"), F.sha2(body, 256).alias("request_hash"),
        F.when(eid % 11 == 0, F.lit(None).cast("boolean")).otherwise(is_error | (F.col("value") > 60.0)).alias("counts"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    return trace_columns(load(spark, d, "events"))


def event_log_columns(events: DataFrame) -> DataFrame:
    """Six provider events per request; every thirteenth request breaks off after three."""
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.floor("value").cast("bigint")
    none = F.lit(None).cast("bigint")
    steps = [
        ("start", k, F.lit(1).cast("bigint"), F.lit(None).cast("string")),
        ("text", none, none, F.col("event_type")),
        ("usage", none, F.floor(out / 2).cast("bigint"), F.lit(None).cast("string")),
        ("text", none, none, F.concat(F.lit("-"), k.cast("string"))),
        ("thinking", none, none, F.lit("hm")),
        ("finish", none, out, F.lit(None).cast("string")),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), a.alias("input_tokens"), b.alias("output_tokens"), delta.alias("delta"))
        for i, (kind, a, b, delta) in enumerate(steps)])
    flat = events.select(eid.alias("request_id"), F.col("ts").cast("timestamp").alias("_t"), model_of(eid).alias("model"), F.inline(rows))
    kept = flat.filter(~((F.col("request_id") % 13 == 0) & (F.col("seq") >= 3)))
    return kept.select(
        "request_id", "seq", "kind", F.timestamp_add("SECOND", F.col("seq"), F.col("_t")).alias("at"), "model",
        "input_tokens", "output_tokens", F.lit(None).cast("bigint").alias("cache_read_tokens"),
        F.lit(None).cast("bigint").alias("cache_write_tokens"), "delta",
        F.when(F.col("kind") == "finish", F.lit("stop")).alias("finish_reason"))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return event_log_columns(load(spark, d, "events"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars")
    marks = load(spark, d, "labels")
    human = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "win").when(F.col("quality") == 1, "tie").otherwise("loss")
    return docs.join(marks, "doc_id").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("pair_id"), F.col("lang").alias("task_type"), human.alias("human"),
        (F.col("n_chars") * 7 % 20000).alias("elapsed_ms"), "n_chars",
        F.when(uniform(F.lit("shown"), F.col("doc_id")) < 0.5, "A").otherwise("B").alias("candidate_shown_as"))


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """A judge that agrees with people three times in four; a few replies missing or unreadable."""
    base = labels(spark, d)
    doc = F.col("doc_id")
    other = F.when(F.col("n_chars") % 3 == 0, "win").when(F.col("n_chars") % 3 == 1, "tie").otherwise("loss")
    chosen = F.when(uniform(F.lit("j"), doc) < 0.75, F.col("human")).otherwise(other)
    lost = uniform(F.lit("parse"), doc) < 0.05
    return base.filter(uniform(F.lit("miss"), doc) >= 0.03).select(
        "pair_id", F.when(~lost, chosen).alias("outcome"), lost.alias("unparseable"),
        (uniform(F.lit("flip"), doc) < 0.1).alias("position_flip"))


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Two raw replies per document, in the shapes judges use, valid and not."""
    doc = F.col("doc_id")
    base = load(spark, d, "documents").select(
        "doc_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("position"))
    u = uniform(F.lit("reply"), doc, F.col("position"))
    mark = F.when(u < 0.4, "A").when(u < 0.8, "B").otherwise("tie")
    conf = (F.floor(u * 100) / 100).cast("string")
    plain = F.concat(F.lit('{"outcome": "'), mark, F.lit('", "confidence": '), conf, F.lit("}"))
    bare = F.concat(F.lit('{"outcome": "'), mark, F.lit('"}'))
    form = (doc + F.when(F.col("position") == "A", 0).otherwise(1)) % 8
    raw = (
        F.when(form == 0, plain)
        .when(form == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("My view: "), plain, F.lit(" as said.")))
        .when(form == 3, bare)
        .when(form == 4, F.concat(F.lit("```\n"), bare, F.lit("\n```")))
        .when((form == 5) & (doc % 3 == 0), F.lit('{"outcome": "C", "confidence": 0.9}'))
        .when((form == 6) & (doc % 3 == 0), F.concat(F.lit('{"outcome": "'), mark, F.lit('", "confidence": 5}')))
        .when((form == 7) & (doc % 3 == 0), F.lit(""))
        .otherwise(plain))
    return base.select(F.concat(F.lit("doc-"), doc).alias("pair_id"), "position", raw.alias("raw"))


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(
        F.col("source").alias("source_dataset"), F.col("doc_id").cast("string").alias("source_id"), F.lit("CC0").alias("source_license"),
        F.col("lang").alias("task_type"), "text", "doc_id", F.lit(None).cast("string").alias("ground_truth"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("slug"), F.col("embedding").alias("vec"), "label")


def reworded(spark: SparkSession, d: str) -> DataFrame:
    """A second vector per item, drawn toward the next item by a share that depends on the id; the first follows the last."""
    base = vectors(spark, d)
    ends = base.agg(F.min("slug").alias("_first"), F.max("slug").alias("_last"))  # one row
    after = base.crossJoin(ends).select(
        F.when(F.col("slug") == F.col("_first"), F.col("_last")).otherwise(F.col("slug") - 1).alias("slug"), F.col("vec").alias("_next"))
    share = (F.col("slug") % 21) / F.lit(10.0)
    mixed = F.zip_with("vec", "_next", lambda a, b: (a.cast("double") + share * b.cast("double")).cast("float"))
    return base.join(after, "slug").select("slug", mixed.alias("vec"))


def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers: two versions, three models, a part of them already expired."""
    slug = F.col("slug")
    return vectors(spark, d).select(
        slug.alias("entry_id"), "vec", model_of(slug).alias("model"), F.when(slug % 2 == 0, "v1").otherwise("v2").alias("prompt_version"),
        F.timestamp_add("SECOND", (slug * 37 % 1000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("expires_at"))


def cache_queries(spark: SparkSession, d: str) -> DataFrame:
    slug = F.col("slug")
    return reworded(spark, d).select(
        slug.alias("query_id"), "vec", model_of(slug).alias("model"), F.when(slug % 2 == 0, "v1").otherwise("v2").alias("prompt_version"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return request_columns(load(spark, d, "events"))


def request_columns(events: DataFrame) -> DataFrame:
    """Routing requests from events: pinned and routed, with and without hints and overrides."""
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    role = F.when(eid % 29 == 0, "system").otherwise("user")
    return events.select(
        eid.alias("request_id"), F.when(eid % 4 == 0, CHEAP).otherwise("auto").alias("model"),
        F.when(eid % 5 == 0, "  ").when(eid % 5 == 1, F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
        .when(eid % 5 == 2, "elsewhere").when(eid % 5 == 3, F.col("event_type")).alias("route_hint"),
        F.when(eid % 7 == 0, " OFF ").when(eid % 7 == 1, "bogus").when(eid % 7 == 2, "offline").alias("mode_header"),
        F.when(k % 3 == 0, k / 40.0).alias("temperature"), F.when(k % 4 == 0, k / 90.0).alias("top_p"),
        F.when(k % 5 == 0, k - 10).alias("max_tokens"), F.when(k % 6 == 0, k * 1000).alias("max_completion_tokens"),
        F.when(k % 7 == 0, k % 3).alias("n"),
        F.when(k % 8 == 0, F.transform(F.sequence(F.lit(1), k % 6 + 1), lambda i: i.cast("string"))).alias("stop"),
        F.array(F.struct(role.alias("role"), F.col("event_type").alias("content"))).alias("messages"),
        (eid % 2 == 0).alias("pinned"), model_of(eid).alias("target"))
