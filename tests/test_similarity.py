"""Neighbour search against brute force, cache lookups and calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import similarity as sim


def clustered(n, dim, seed, hot=0.0):
    """Unit vectors around a few centres; a share ``hot`` of them around one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    pick = np.where(rng.random(n) < hot, 0, rng.integers(0, 6, n))
    v = centres[pick] + 0.35 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, v, name, **extra):
    rows = [(i, [float(x) for x in row], *[values[i] for values in extra.values()]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, f"{name} bigint, vec array<float>" + "".join(f", {k} string" for k in extra)).repartition(5)


def brute(q, e, k, exclude_self=False, allowed=None, floor=None):
    qi, ei = (np.floor(x.astype(float) * sim.SCALE + 0.5) for x in (q, e))
    s = (qi @ ei.T) / (np.sqrt((qi**2).sum(1))[:, None] * np.sqrt((ei**2).sum(1))[None, :])
    if exclude_self:
        np.fill_diagonal(s, -np.inf)
    out = {}
    for i in range(len(q)):
        js = [j for j in range(len(e)) if np.isfinite(s[i, j]) and (allowed is None or allowed(i, j)) and (floor is None or s[i, j] >= floor)]
        js.sort(key=lambda j: (-s[i, j], -j))
        out[i] = [(j, s[i, j]) for j in js[:k]]
    return {i: r for i, r in out.items() if r}


def collected(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["eid"], r["similarity"]))
    return out


@pytest.mark.parametrize("pivots,block,chunk,hot", [(1, 1024, 4096, 0.0), (1, 40, 30, 0.0), (7, 25, 40, 0.4), (12, 1000, 1000, 0.0)])
def test_search_is_exact(spark, pivots, block, chunk, hot):
    v = clustered(300, 16, 3, hot)
    got = sim.top_k_similar(frame(spark, v, "qid"), frame(spark, v, "eid"), 4, exclude_self=True, pivots=pivots, block_rows=block, chunk_rows=chunk)
    assert collected(got) == brute(v, v, 4, exclude_self=True)


@pytest.mark.parametrize("pivots", [1, 24])
def test_most_pairs_of_clustered_vectors_are_never_multiplied(spark, pivots):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(24, 48))[rng.integers(0, 24, 2400)] + 0.1 * rng.normal(size=(2400, 48))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    args = dict(exclude_self=True, pivots=pivots, block_rows=2400 if pivots == 1 else 200, chunk_rows=600)
    work = sim.search_work(frame(spark, v, "qid"), frame(spark, v, "eid"), 3, **args).first()
    assert work["multiplied"] <= work["pairs"] <= 2400 * 2400 and work["share"] == work["multiplied"] / 2400**2
    assert work["share"] < 0.5
    assert collected(sim.top_k_similar(frame(spark, v, "qid"), frame(spark, v, "eid"), 3, **args)) == brute(v, v, 3, exclude_self=True)


def test_more_neighbours_than_a_cell_holds(spark):
    v = clustered(60, 8, 9)
    got = sim.top_k_similar(frame(spark, v, "qid"), frame(spark, v, "eid"), 25, exclude_self=True, pivots=10, block_rows=10, chunk_rows=10)
    assert collected(got) == brute(v, v, 25, exclude_self=True)


def test_copies_are_all_kept_and_ties_go_to_the_larger_id(spark):
    v = np.repeat(clustered(3, 8, 1), 50, axis=0)
    got = collected(sim.top_k_similar(frame(spark, v, "qid"), frame(spark, v, "eid"), 3, exclude_self=True, pivots=2, block_rows=20, chunk_rows=20))
    assert len(got) == 150 and [j for j, _ in got[0]] == [49, 48, 47] and [j for j, _ in got[49]] == [48, 47, 46]


@pytest.mark.parametrize("pivots", [1, 6])
def test_scoped_search_with_a_floor(spark, pivots):
    q, e = clustered(120, 12, 5), clustered(200, 12, 5)
    qs, es = ["hot" if i % 3 else None for i in range(120)], ["hot" if i % 4 else ("cold" if i % 8 else None) for i in range(200)]
    got = sim.top_k_similar(frame(spark, q, "qid", s=qs), frame(spark, e, "eid", s=es), 2, ["s"], 0.8, pivots=pivots, block_rows=30, chunk_rows=20)
    assert collected(got) == brute(q, e, 2, allowed=lambda i, j: qs[i] == es[j], floor=0.8)


def test_lookup_ignores_lapsed_and_foreign_entries(spark):
    schema = "entry_id string, vec array<float>, model string, prompt_version string, expires_at string"
    entries = spark.createDataFrame([("old", [1.0, 0.0], "m", "v", "2024-01-01 00:00:00"), ("other", [1.0, 0.0], "n", "v", "2025-01-01 00:00:00"),
                                     ("near", [0.9, 0.1], "m", "v", "2025-01-01 00:00:00"), ("far", [0.0, 1.0], "m", "v", "2025-01-01 00:00:00")], schema)
    entries = entries.withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    queries = spark.createDataFrame([("q1", [1.0, 0.0], "m", "v"), ("q2", [1.0, 0.0], "m", "w"), ("q3", [-1.0, 0.2], "m", "v")], "query_id string, vec array<float>, model string, prompt_version string")
    got = {r["query_id"]: (r["entry_id"], r["hit"]) for r in sim.semantic_lookup(queries, entries, 0.9, F.lit("2024-06-01").cast("timestamp")).collect()}
    assert got == {"q1": ("near", True), "q2": (None, False), "q3": (None, False)}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([0.6, 0.8], [0.6, 0.8])], "a array<float>, b array<float>")
    both = df.select(sim.cosine(sim.fixed_point(F.col("a")), sim.fixed_point(F.col("b")))).collect()
    assert [r[0] for r in both] == [0.0, pytest.approx(1.0)]
    with pytest.raises(Exception, match="dimension mismatch"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(sim.cosine(sim.fixed_point(F.col("a")), sim.fixed_point(F.col("b")))).collect()


def test_paraphrases_without_vectors_are_skipped(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, 0.0])], "slug string, vec array<float>")
    reworded = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "slug string, vec array<float>")
    assert [r["pair_id"] for r in sim.paraphrase_pairs(items, reworded).collect()] == ["pos:a"]


def pairs(spark, dup, diff):
    rows = [(f"d{i}", "duplicate", s) for i, s in enumerate(dup)] + [(f"n{i}", "different", s) for i, s in enumerate(diff)]
    return spark.createDataFrame(rows, "pair_id string, label string, similarity double")


def test_threshold_counts_are_inclusive_and_drop_unscored(spark):
    got = {r["threshold"]: r for r in sim.threshold_counts(pairs(spark, [0.85, 0.9, None], [0.84, 0.99])).collect()}
    assert len(got) == 41
    assert (got[0.85]["n_duplicates"], got[0.85]["duplicate_hits"], got[0.85]["false_hits"]) == (2, 2, 1)
    assert got[0.855]["duplicate_hits"] == 1 and got[1.0]["false_hits"] == 0


def test_both_kinds_are_needed(spark):
    with pytest.raises(Exception):
        sim.calibrate_threshold(pairs(spark, [0.9], [])).collect()


def chosen(spark, dup, diff):
    return sim.chosen_threshold(sim.calibrate_threshold(pairs(spark, dup, diff))).first()


def test_refusals(spark):
    assert chosen(spark, [0.95] * 50, [0.5] * 20)["refusal"] == "sample_size"
    assert chosen(spark, [0.81] * 100, [0.9] * 20 + [0.5] * 600)["refusal"] == "safe_not_useful"
    assert chosen(spark, [0.95] * 50, [1.0] * 400)["refusal"] == "none_safe"


def test_choice_prefers_the_lower_threshold_on_ties(spark):
    row = chosen(spark, [0.95] * 50, [0.5] * 600)
    assert row["threshold"] == 0.8 and row["refusal"] is None and row["hit_rate"] == 1.0


def test_price_table(spark):
    curve = sim.calibrate_threshold(pairs(spark, [0.95] * 50 + [0.85] * 50, [0.9] * 12 + [0.5] * 600))
    got = {r["tolerance"]: (r["hit_rate"], r["threshold"]) for r in sim.price_of_usefulness(curve).collect()}
    assert got[0.01] == (0.5, 0.905) and got[0.05] == (1.0, 0.8) and len(got) == 5


def test_evidence_gap(spark):
    row = sim.evidence_gap(sim.threshold_counts(pairs(spark, [0.9], [0.5] * 100))).first()
    assert (row["required"], row["shortfall"]) == (368, 268)


def routed(spark, v, parts, **extra):
    rows = [(f"i{i}", [float(x) for x in row], f"task-{i % 3}", extra.get("split", ["dev"] * len(v))[i]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "slug string, vec array<float>, task_type string, split string").repartition(parts)


def test_routes_do_not_depend_on_partitions(spark):
    v = clustered(240, 8, 4)
    a, b = (sorted(map(tuple, sim.discover_routes(routed(spark, v, n), (2, 6, 9)).collect())) for n in (1, 7))
    assert a == b and sum(r[2] for r in a) == 240 and len(a) in (2, 6, 9)


def test_routes_separate_far_groups(spark):
    rng = np.random.default_rng(8)
    v = np.vstack([np.eye(3)[i] + 0.01 * rng.normal(size=(40, 3)) for i in range(3)])
    got = sim.discover_routes(routed(spark, v, 3), (2, 3), seed=5).collect()
    found = {tuple(np.round(r["centroid"], 1) + 0.0): r["n_items"] for r in got}
    means = {tuple(np.round(v[i * 40:i * 40 + 40].mean(axis=0), 1) + 0.0): 40 for i in range(3)}
    assert found == means


def test_routes_are_learned_from_training_rows_only(spark):
    v = clustered(90, 6, 2)
    splits = ["test" if i < 30 else "dev" for i in range(90)]
    assert sum(r["n_items"] for r in sim.discover_routes(routed(spark, v, 2, split=splits), (2, 4)).collect()) == 60
    both = routed(spark, v, 2).unionByName(routed(spark, v[:1], 1, split=["test"]))
    with pytest.raises(ValueError, match="more than one split"):
        sim.discover_routes(both, (2,))


def test_copies_are_one_start_and_too_few_vectors_are_refused(spark):
    v = np.repeat(clustered(2, 6, 3), 40, axis=0)
    got = sim.discover_routes(routed(spark, v, 3), (2,)).collect()
    assert sorted(r["n_items"] for r in got) == [40, 40] and got[0]["silhouette"] == 1.0
    with pytest.raises(ValueError, match="3 routes need"):
        sim.discover_routes(routed(spark, v, 3), (2, 3))
    with pytest.raises(ValueError, match="found 0"):
        sim.discover_routes(routed(spark, v, 3).limit(0), (2,))


def test_a_row_is_sent_to_few_tasks_whatever_the_blocks(spark):
    v = clustered(2000, 16, 7)
    found = sim._search(frame(spark, v, "qid"), frame(spark, v, "eid"), 3, [], None, True, 16, 8, 8)
    work = found.filter(F.col("pairs").isNotNull()).agg(F.count(F.lit(1)), F.sum("pairs")).first()
    assert work[0] <= 4 * sim.SIDE**2 and work[1] <= 2000**2


def test_a_row_is_copied_as_often_at_every_size(spark):
    sizes = (10_256, 102_564, 615_384)
    assert [sim._Blocks([(0, n, 2.0)], sim.BLOCK_ROWS).count for n in sizes] == [sim.SIDE] * 3
    visits = spark.createDataFrame([(n,) for n in sizes], "n long")
    chunks = lambda side: [r[0] for r in visits.orderBy("n").select(sim._chunks(F.col("n"), sim.CHUNK_ROWS, side)).collect()]
    assert chunks(sim.SIDE) == [sim.SIDE] * 3
    assert chunks(sim.HOME_SIDE)[:2] == [sim.HOME_SIDE] * 2


def test_vectors_are_dealt_without_a_join(spark):
    """Only the two sides of each round are shuffled; entries get their block and both sides their chunk in place."""
    v = clustered(400, 8, 4)
    found = sim._search(frame(spark, v, "qid"), frame(spark, v, "eid"), 1, [], 0.5, True, 8, 32, 32)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("CoGroup") == 1


@pytest.mark.parametrize("pivots,block,k", [(1, 64, 1), (5, 128, 3), (1, 4000, 2)])
def test_vectors_without_clusters(spark, pivots, block, k):
    v = (np.random.default_rng(4).normal(size=(1500, 24)) / 8).astype(np.float32)
    v[::7] = v[0]  # many copies of one
    v[3] = 0
    got = sim.top_k_similar(frame(spark, v, "qid"), frame(spark, v, "eid"), k, exclude_self=True, pivots=pivots, block_rows=block, chunk_rows=50)
    assert collected(got) == brute_zero(v, k)


def brute_zero(v, k):
    """Like ``brute``; a vector without length has similarity 0 to all."""
    x = np.floor(v.astype(float) * sim.SCALE + 0.5)
    norms = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :]
    s = np.divide(x @ x.T, norms, out=np.zeros_like(norms), where=norms > 0)
    np.fill_diagonal(s, -np.inf)
    return {i: [(j, s[i, j]) for j in sorted(range(len(v)), key=lambda j: (-s[i, j], -j))[:k]] for i in range(len(v))}
