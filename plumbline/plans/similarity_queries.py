"""Neighbours, cache lookups and cache thresholds over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import similarity as sim
from plumbline.plans import fixtures as fx, oracle as o
from plumbline.plans.registry import registered

GRID = tuple(round(0.20 + i * 0.02, 4) for i in range(41))
NOW = "2024-01-01 00:05:00"
_FIXED = "list_transform({v}, lambda x: floor(x::DOUBLE*16777216.0+0.5)::DOUBLE)"
_SIM = "list_inner_product(a.v,b.v)/(a.norm*b.norm)"


def _with_norm(sql: str) -> str:
    return f"SELECT *, sqrt(list_inner_product(v,v)) AS norm FROM ({sql})"


_VEC = _with_norm(f"SELECT slug, label, {_FIXED.format(v='vec')} AS v FROM vectors")
_REW = _with_norm(f"SELECT slug, {_FIXED.format(v='vec')} AS v FROM reworded")
_NEAR = f"SELECT a.slug AS l, b.slug AS r, {_SIM} AS s, row_number() OVER (PARTITION BY a.slug ORDER BY {_SIM} DESC, b.slug DESC)::INT AS rk FROM fixed a JOIN fixed b ON a.slug<>b.slug"


@registered("hard_negatives", o.query("SELECT l AS left_slug, r AS right_slug, s AS similarity, rk AS rank FROM near WHERE rk<=1", "vectors", fixed=_VEC, near=_NEAR))
def hard_negatives(spark, d):
    return sim.hard_negatives(fx.vectors(spark, d), 1).select("left_slug", "right_slug", "similarity", "rank")


@registered("top_k_similar", o.query("SELECT l AS qid, r AS eid, s AS similarity, rk AS rank FROM near WHERE rk<=5", "vectors", fixed=_VEC, near=_NEAR))
def top_k_similar(spark, d):
    v = fx.vectors(spark, d)
    return sim.top_k_similar(v.select(F.col("slug").alias("qid"), "vec"), v.select(F.col("slug").alias("eid"), "vec"), 5, exclude_self=True)


@registered("top_k_cells", o.query("SELECT l AS qid, r AS eid, s AS similarity, rk AS rank FROM near WHERE rk<=5", "vectors", fixed=_VEC, near=_NEAR))
def top_k_cells(spark, d):
    """The same search in 16 cells, blocks of 64 entries and chunks of 128 queries."""
    v = fx.vectors(spark, d)
    return sim.top_k_similar(v.select(F.col("slug").alias("qid"), "vec"), v.select(F.col("slug").alias("eid"), "vec"), 5, exclude_self=True,
                             pivots=16, block_rows=64, chunk_rows=128)


_POS = f"SELECT 'pos:'||a.slug AS pair_id, a.slug AS left_slug, a.slug||'#paraphrase' AS right_slug, 'duplicate' AS label, {_SIM} AS similarity FROM fixed a JOIN fixed_r b ON a.slug=b.slug"


@registered("paraphrase_pairs", o.query("SELECT * FROM pos", "reworded", fixed=_VEC, fixed_r=_REW, pos=_POS))
def paraphrase_pairs(spark, d):
    return sim.paraphrase_pairs(fx.vectors(spark, d), fx.reworded(spark, d)).drop("source")


_PAIRS = "SELECT pair_id, label, similarity FROM pos UNION ALL SELECT 'neg:'||l||'|'||r, 'different', s FROM near WHERE rk=1"
_BASE = dict(fixed=_VEC, fixed_r=_REW, near=_NEAR, pos=_POS, pairs=_PAIRS)


def _pairs(spark, d):
    return sim.labelled_pairs(sim.paraphrase_pairs(fx.vectors(spark, d), fx.reworded(spark, d)), sim.hard_negatives(fx.vectors(spark, d)))


@registered("labelled_pairs", o.query("SELECT * FROM pairs", "reworded", **_BASE))
def labelled_pairs(spark, d):
    return _pairs(spark, d)


_COUNTS = f"""SELECT threshold, count(*) FILTER (label='duplicate') AS n_duplicates, count(*) FILTER (label='duplicate' AND similarity>=threshold) AS duplicate_hits,
  count(*) FILTER (label='different') AS n_different, count(*) FILTER (label='different' AND similarity>=threshold) AS false_hits FROM pairs, {o.grid_values(GRID)} GROUP BY threshold"""


@registered("threshold_counts", o.query("SELECT * FROM counts", "reworded", **_BASE, counts=_COUNTS))
def threshold_counts(spark, d):
    return sim.threshold_counts(_pairs(spark, d), GRID)


_CURVE = """SELECT c.threshold, duplicate_hits/n_duplicates::DOUBLE AS hit_rate, b.low/n_duplicates::DOUBLE AS hit_ci_low, b.high/n_duplicates::DOUBLE AS hit_ci_high, n_duplicates,
  false_hits/n_different::DOUBLE AS false_hit_rate, p.low AS false_hit_ci_low, p.high AS false_hit_ci_high, n_different, p.high<=0.01 AS acceptable, 1.0-duplicate_hits/n_duplicates::DOUBLE AS miss_rate
  FROM counts c JOIN bounds b USING (threshold) JOIN clopper p USING (threshold)"""
_CURVED = dict(**_BASE, counts=_COUNTS, dups="SELECT threshold, n_duplicates AS n, duplicate_hits AS b, 0::BIGINT AS c FROM counts",
               **o.interval_ctes("dups", ["threshold"], resamples=4000), diffs="SELECT threshold, n_different AS n, false_hits AS k FROM counts",
               **o.exact_bound_ctes("diffs", ["threshold"]), curve=_CURVE)


def _curve(spark, d):
    return sim.calibrate_threshold(_pairs(spark, d), GRID)


@registered("calibrate_threshold", o.query("SELECT * FROM curve", "reworded", **_CURVED))
def calibrate_threshold(spark, d):
    return _curve(spark, d)


@registered("evidence_gap", o.query(
    "SELECT n_different, 368 AS required, greatest(0,368-n_different) AS shortfall FROM (SELECT max(n_different) AS n_different FROM counts)", "reworded", **_BASE, counts=_COUNTS))
def evidence_gap(spark, d):
    return sim.evidence_gap(sim.threshold_counts(_pairs(spark, d), GRID))


_CHOSEN = """SELECT s.n_duplicates, s.n_different, s.safe_points, c.threshold, c.hit_rate, c.false_hit_rate, c.false_hit_ci_high,
       CASE WHEN c.threshold IS NOT NULL THEN NULL WHEN s.n_different<368 THEN 'sample_size' WHEN s.safe_points>0 THEN 'safe_not_useful' ELSE 'none_safe' END AS refusal
       FROM (SELECT max(n_duplicates) AS n_duplicates, max(n_different) AS n_different, count(*) FILTER (acceptable) AS safe_points FROM curve) s
       LEFT JOIN (SELECT * FROM curve WHERE acceptable AND hit_rate>=0.05 ORDER BY hit_rate DESC, threshold LIMIT 1) c ON true"""


@registered("chosen_threshold", o.query(_CHOSEN, "reworded", **_CURVED))
def chosen_threshold(spark, d):
    return sim.chosen_threshold(_curve(spark, d))


_PRICE = """SELECT tolerance, coalesce(max_by(hit_rate,(hit_rate,-threshold)) FILTER (ok),0.0) AS hit_rate, coalesce(max_by(threshold,(hit_rate,-threshold)) FILTER (ok),0.0) AS threshold FROM (
       SELECT *, false_hit_ci_high<=tolerance AND hit_rate>=0.05 AS ok FROM curve, (VALUES (0.01::DOUBLE),(0.02),(0.03),(0.05),(0.10)) t(tolerance)) GROUP BY tolerance"""


@registered("price_of_usefulness", o.query(_PRICE, "reworded", **_CURVED))
def price_of_usefulness(spark, d):
    return sim.price_of_usefulness(_curve(spark, d))


_RATES = "SELECT task_type, split, model, count(*) AS n, count(*) FILTER (NOT success) AS k FROM records GROUP BY ALL"


@registered("exact_bounds", o.query(
    "SELECT task_type, split, model, k, n, low, high FROM fails JOIN clopper USING (task_type, split, model)", "records", fails=_RATES,
    **o.exact_bound_ctes("fails", ["task_type", "split", "model"])))
def exact_bounds(spark, d):
    """Failure rate of every model on every task and split, with exact bounds."""
    counts = fx.records_long(spark, d).groupBy("task_type", "split", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("k"))
    return counts.withColumn("_ci", stats.exact_bounds(F.col("k"), F.col("n"))).select("task_type", "split", "model", "k", "n", "_ci.low", "_ci.high")


_SCOPED = """slug, CASE WHEN slug%3=0 THEN 'm-small' WHEN slug%3=1 THEN 'm-mid' ELSE 'm-large' END AS model, CASE WHEN slug%2=0 THEN 'v1' ELSE 'v2' END AS prompt_version, v, norm"""


@registered("semantic_lookup", o.query(
    """SELECT q.slug AS query_id, q.model, q.prompt_version, h.eid AS entry_id, h.s AS similarity, h.eid IS NOT NULL AS hit FROM queries q LEFT JOIN (
       SELECT * FROM (SELECT a.slug AS qid, b.slug AS eid, {s} AS s, row_number() OVER (PARTITION BY a.slug ORDER BY {s} DESC, b.slug DESC) AS rk FROM queries a JOIN entries b USING (model, prompt_version)
         WHERE b.expires_at>TIMESTAMP '{now}') WHERE rk=1 AND s>=0.75) h ON h.qid=q.slug""".format(s=_SIM, now=NOW), "reworded", fixed=_VEC, fixed_r=_REW,
    queries=f"SELECT {_SCOPED} FROM fixed_r", entries=f"SELECT {_SCOPED}, TIMESTAMP '2024-01-01 00:00:00'+to_seconds(slug*37%1000) AS expires_at FROM fixed"))
def semantic_lookup(spark, d):
    return sim.semantic_lookup(fx.cache_queries(spark, d), fx.cache_entries(spark, d), 0.75, F.lit(NOW).cast("timestamp"))


_CENTROIDS = """SELECT 'route-'||label AS route_key, list(c ORDER BY i) AS vec, CASE WHEN label%2=0 THEN 'm-small' ELSE 'm-mid' END AS assigned_model FROM (
  SELECT label, i, sum(floor(vec[i]::DOUBLE*16777216.0+0.5)::BIGINT)/count(*)::DOUBLE/16777216.0 AS c FROM vectors, range(1,65) r(i) GROUP BY label, i) GROUP BY label"""


def centroids(vectors):
    """Mean vector of every label, summed in fixed point."""
    parts = vectors.select("label", F.posexplode(sim.fixed_point(F.col("vec"))).alias("i", "x")).groupBy("label", "i").agg(
        (F.sum(F.col("x").cast("bigint")) / F.count(F.lit(1)) / F.lit(16777216.0)).alias("c"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("centroid")).select(
        F.concat(F.lit("route-"), "label").alias("route_key"), "centroid", F.when(F.col("label") % 2 == 0, fx.CHEAP).otherwise(fx.MID).alias("assigned_model"))


@registered("nearest_route", o.query(
    """SELECT slug, CASE WHEN s>=0.3 THEN r END AS route_key, s AS similarity, CASE WHEN s>=0.3 THEN assigned_model ELSE 'm-large' END AS model_served,
       CASE WHEN s>=0.3 THEN 'nearest_route' ELSE 'out_of_distribution' END AS reason FROM (
       SELECT a.slug, b.route_key AS r, b.assigned_model, {s} AS s, row_number() OVER (PARTITION BY a.slug ORDER BY {s} DESC, b.route_key DESC) AS rk FROM fixed a, centres b) WHERE rk=1""".format(s=_SIM),
    "vectors", fixed=_VEC, cents=_CENTROIDS, centres=_with_norm(f"SELECT route_key, assigned_model, {_FIXED.format(v='vec')} AS v FROM cents")))
def nearest_route(spark, d):
    v = fx.vectors(spark, d)
    return sim.nearest_route(v, centroids(v), 0.3, fx.STRONG)


_ROUTE_KS, _ROUNDS = (3, 6), 5


def _route_ctes() -> dict[str, str]:
    """Rounds of k-means written out: spread start centres, then means of the nearest rows, for every k."""
    far = "min(list_inner_product(p.v,p.v)-2.0*list_inner_product(p.v,q.v)+list_inner_product(q.v,q.v))"
    last = max(_ROUTE_KS) - 1
    ctes = {
        "train": f"SELECT slug, 'task-'||label AS task, {_FIXED.format(v='vec')} AS v FROM vectors WHERE {o.split('slug')}<>'test'",
        "pool": f"SELECT row_number() OVER (ORDER BY h, s) AS rk, v FROM (SELECT v, min(h) AS h, arg_min(s,(h,s)) AS s FROM (SELECT v, md5('1|'||slug) AS h, slug::VARCHAR AS s FROM train) GROUP BY v) ORDER BY rk LIMIT {sim.DRAWN * max(_ROUTE_KS)}",
        "pick0": "SELECT 0 AS c, v FROM pool WHERE rk=1",
    }
    for i in range(1, last + 1):
        ctes[f"pick{i}"] = f"""SELECT * FROM pick{i - 1} UNION ALL SELECT {i} AS c, v FROM (SELECT rk, p.v AS v FROM pool p, pick{i - 1} q GROUP BY rk, p.v ORDER BY {far} DESC, rk LIMIT 1)"""
    ctes["centre0"] = f"SELECT k, c, v, list_inner_product(v,v) AS vv FROM pick{last}, (VALUES " + ",".join(f"({k})" for k in _ROUTE_KS) + ") t(k) WHERE c<k"
    for r in range(_ROUNDS + 1):
        ctes[f"placed{r}"] = f"""SELECT k, slug, task, v, c, near, lead_near FROM (SELECT k, slug, task, a.v AS v, c, sqrt(d) AS near, lead(sqrt(d)) OVER w AS lead_near, row_number() OVER w AS rk FROM (
          SELECT k, slug, task, a.v, c, list_inner_product(a.v,a.v)-2.0*list_inner_product(a.v,b.v)+vv AS d FROM train a, centre{r} b) a WINDOW w AS (PARTITION BY k, slug ORDER BY d, c)) WHERE rk=1"""
        if r < _ROUNDS:
            ctes[f"centre{r + 1}"] = f"""SELECT k, c, v, list_inner_product(v,v) AS vv FROM (SELECT k, c, coalesce(m.v, b.v) AS v FROM centre{r} b LEFT JOIN (
              SELECT k, c, list(x ORDER BY i) AS v FROM (SELECT k, c, i, floor(sum(v[i]::BIGINT)::DOUBLE/count(*)::DOUBLE+0.5) AS x FROM placed{r}, range(1,65) r(i) GROUP BY k, c, i) GROUP BY k, c) m USING (k, c))"""
    ctes["scores"] = f"""SELECT k, sum(CASE WHEN lead_near>0 THEN floor((lead_near-near)/lead_near*1073741824.0::DOUBLE+0.5) ELSE 0 END::BIGINT)::DOUBLE/1073741824.0::DOUBLE/count(*)::DOUBLE AS silhouette
      FROM placed{_ROUNDS} GROUP BY k"""
    ctes["best"] = "SELECT arg_max(k,(silhouette,-k)) AS k FROM scores"
    return ctes


@registered("discover_routes", o.query(
    f"""SELECT 'route-'||lpad(c::VARCHAR,2,'0') AS route_key, arg_max(task,(n,task)) AS task_type, sum(n)::BIGINT AS n_items, any_value(array_to_string(list_transform(b.v, lambda x: x::BIGINT::VARCHAR),',')) AS centre,
       any_value(silhouette) AS silhouette FROM (SELECT k, c, task, count(*) AS n FROM placed{_ROUNDS} GROUP BY ALL) JOIN best USING (k) JOIN scores USING (k) JOIN centre{_ROUNDS} b USING (k, c) GROUP BY c""",
    "vectors", **_route_ctes()))
def discover_routes(spark, d):
    """Routes of all training rows, centres in units of 2^-24; the rounds are written out in the SQL."""
    v = fx.vectors(spark, d).withColumn("task_type", F.concat(F.lit("task-"), "label")).withColumn("split", fx.split_of_key(F.col("slug")))
    units = F.transform("centroid", lambda x: (x * sim.SCALE).cast("bigint").cast("string"))
    return sim.discover_routes(v, _ROUTE_KS, rounds=_ROUNDS).select(
        "route_key", "task_type", "n_items", "silhouette", F.array_join(units, ",").alias("centre"))
