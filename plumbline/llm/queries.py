"""The training-data operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    decontaminate, fertility, filter_audit, language_ranks, license_index, minimax_shards, packing, pitman_yor, prefix_trie, quality_cnn, simhash,
    token_files, toxicity_mil,
)
from plumbline.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_cnn(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, read(spark, d, "labels")))


def op2_tokeniser_fertility(spark: SparkSession, d: str) -> DataFrame:
    return fertility.apply_rules(read(spark, d, "documents"))


def op3_minimax_shards(spark: SparkSession, d: str) -> DataFrame:
    return minimax_shards.shard_documents(read(spark, d, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark")).drop("row")


def op5_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_index.scan(read(spark, d, "documents"))


def op6_toxicity_mil(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return toxicity_mil.score(docs, toxicity_mil.train(docs, read(spark, d, "labels"))).drop("offending")


def op7_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, d, "documents")).select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"))


def op9_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_files.round_trip(read(spark, d, "documents"))


def op10_pitman_yor(spark: SparkSession, d: str) -> DataFrame:
    return pitman_yor.score_documents(read(spark, d, "documents"))


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, d, "conversations"))


def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(read(spark, d, "documents"), read(spark, d, "labels"))


def op13_language_ranks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return language_ranks.identify(docs, language_ranks.train(docs))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_cnn, op2_tokeniser_fertility, op3_minimax_shards, op4_benchmark_decontamination, op5_license_scan,
    op6_toxicity_mil, op7_simhash_near_dedup, op8_best_fit_packing, op9_token_files, op10_pitman_yor,
    op11_prefix_trie, op12_filter_audit, op13_language_ranks)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: crc32 by its polynomial, bit by bit over the characters of an ASCII text.
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ascii(c)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        windows AS MATERIALIZED (
            SELECT DISTINCT item_id, array_to_string(w[k: k + 12], ' ') AS t, least(len(w), 13) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        places AS MATERIALIZED (
            SELECT r, k, n, array_to_string(w[k: k + n - 1], ' ') AS t
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        found AS MATERIALIZED (SELECT DISTINCT r, k, p.n, item_id FROM places p JOIN windows v ON p.t = v.t AND p.n = v.n),
        hit AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM (SELECT r, k, unnest(range(0, n)) AS o FROM found) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op11_prefix_trie": f"""
        WITH own AS MATERIALIZED (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
                   {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
            FROM conversations WHERE conv_id IS NOT NULL),
        listed AS MATERIALIZED (SELECT conv_id, list(t ORDER BY place) AS turns FROM own GROUP BY conv_id),
        drawn AS MATERIALIZED (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, {_CRC32.format(text="CAST(conv_id AS VARCHAR)")} % 6 AS h FROM listed),
        rebuilt AS MATERIALIZED (
            SELECT d.conv_id, list_concat(coalesce(b.turns, [])[1: h], d.turns[h + 1:]) AS turns FROM drawn d LEFT JOIN listed b ON b.conv_id = d.base),
        reached AS MATERIALIZED (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
        places AS MATERIALIZED (SELECT conv_id, n, depth, sha256(to_json(turns[1: depth])::VARCHAR) AS node, sha256(to_json(turns[1: depth - 1])::VARCHAR) AS up,
                                       CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].text) END AS size FROM reached),
        nodes AS MATERIALIZED (
            SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
            FROM places GROUP BY node, depth),
        children AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
        counted AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node, depth)),
        below AS (SELECT DISTINCT a.node, a.depth, b.node AS under, b.depth AS under_depth FROM places a JOIN places b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
        sums AS (SELECT b.node, b.depth, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.size) AS saved
                 FROM below b JOIN counted c ON c.node = b.under AND c.depth = b.under_depth GROUP BY 1, 2)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.ends_sha256
        FROM counted c JOIN sums s USING (node, depth) LEFT JOIN counted p ON c.depth > 0 AND p.node = c.up AND p.depth = c.depth - 1""",
    "op12_filter_audit": r"""
        WITH w AS MATERIALIZED (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS MATERIALIZED (
            SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS failed FROM w),
        l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
        sets AS MATERIALIZED (SELECT part, failed, len(list_filter(failed, lambda x: x)) AS n_failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
                 FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
        v AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        orders AS MATERIALIZED (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM v a, v b, v c, v d, v e
                   WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, v.i AS step FROM orders, v),
        m AS (SELECT part, filter_order, step, n, good, toxic, n_failed, failed[o[step]] AS fails, len(list_filter(o[1: step - 1], lambda x: failed[x])) > 0 AS gone FROM sets, steps)
        SELECT part, filter_order, CAST(step AS INT) AS step,
               CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND n_failed = 1), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(n * (120 // greatest(n_failed, 1))) FILTER (fails), 0) AS BIGINT) AS shapley
        FROM m GROUP BY 1, 2, 3""",
}
