"""SimHash groups and benchmark hits against plain Python over whole small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import components, decontaminate, simhash

WORDS = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Ünder", "été"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def plain_fingerprint(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            groups[root(k)] = min(groups.get(root(k), i), i)
    return sorted(((i, f"{fp:016x}", groups.get(root(k))) for k, (i, fp) in enumerate(fps)), key=repr)


def documents(seed=3):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.randrange(1, 160))) for i in range(60)]
    base = text(rng, 300)
    for i in range(60, 100):  # near copies that drift apart
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        base = " ".join(words)
        rows.append((i, base))
    rows += [(i, "Same Text here, twice and more") for i in range(100, 130)] + [(130, "same text here, twice and more")]
    rows += [(131, None), (132, ""), (133, " \t\n"), (134, "one"), (135, "two words"), (136, "x " * 30000), (137, None), (60, rows[60][1]), (None, rows[3][1]), (None, text(rng, 50))]
    return rows


@pytest.mark.parametrize("block", [4096, 4])
def test_components_equal_brute_force(make, block):
    rows = documents()
    got = simhash.near_duplicates(make(rows), block).select("doc_id", simhash.hex16("fp").alias("f"), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_components(rows)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fps[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 100, dtype=np.uint64))
    rows = np.concatenate([fps, near])
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if int(rows[i] ^ rows[j]).bit_count() <= 3}
    a, b = simhash.close_pairs(rows, rows)
    assert set(zip(a.tolist(), b.tolist())) == want
    for radius in (0, 1, 2):
        a, b = simhash.close_pairs(rows, rows, radius)
        assert set(zip(a.tolist(), b.tolist())) == {p for p in want if int(rows[p[0]] ^ rows[p[1]]).bit_count() <= radius}


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["a"]: r["b"] for r in components.stars(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_empty_tables(make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert decontaminate.decontaminate(make([]), make([]).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_one_of_each_group_stays(make):
    rows = documents()
    kept = [r["doc_id"] for r in simhash.keep_one(make(rows)).collect()]
    want = {c for i, _, c in plain_components(rows) if i is not None}
    assert sorted(i for i in kept if i is not None) == sorted(want)
    assert sum(i is None for i in kept) == 1  # the other null id has a copy with an id


def plain_decontamination(docs, items, window=13):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    by_item = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(window, len(w))
            by_item.setdefault(str(i), set()).update(tuple(w[k: k + n]) for k in range(len(w) - n + 1))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, windows in by_item.items():
            for x in windows:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k: k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add(item)
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [60_000, 3])
def test_decontamination_equals_brute_force(make, block_rows):
    rng = random.Random(5)
    items = [(i, text(rng, n)) for i, n in enumerate((40, 13, 14, 12, 2, 1, 3))] + [(7, None), (8, "..."), (9, "the of the of the of the of the of the of the of the"), (10, text(rng, 20)), (10, text(rng, 20)), (None, "null id item of words")]
    items += [(11, items[0][1])]
    docs = [(i, text(rng, rng.randrange(0, 80))) for i in range(40)]
    docs += [(40 + i, text(rng, 30) + " " + (t or "") + " " + text(rng, 30)) for i, (_, t) in enumerate(items)]
    docs += [(60, items[0][1]), (61, items[0][1].upper().replace(" ", ", ")), (62, None), (63, ""), (64, items[4][1].split(" ")[0]), (60, items[1][1]), (None, items[2][1]),
             (65, "the of " * 5000), (66, " ".join([items[0][1]] * 3) + " tail"), (67, " ".join(items[0][1].split(" ")[:12]))]
    got = decontaminate.decontaminate(make(docs), make(items).withColumnRenamed("doc_id", "item_id"), block_rows=block_rows).drop("row")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_decontamination(docs, items)
    kept = decontaminate.keep_uncontaminated(make(docs), make(items).withColumnRenamed("doc_id", "item_id"), block_rows=block_rows)
    bad = {r[0] for r in plain_decontamination(docs, items) if r[5]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i is not None and i not in bad)


def test_rows_that_share_an_id_are_judged_by_their_texts(make):
    """Two texts of one id are two groups; a copy with the id of another group's smallest row goes."""
    rng = random.Random(21)
    a, b, c = (text(rng, 60) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (None, c), (9, None)]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(make(rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(3, a), (5, b), (8, c), (9, None)], key=repr)
    rows = [(1, a), (1, b), (None, a), (None, b), (2, c)]
    benchmark = make([("x", a)], "item_id string, text string")
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.keep_uncontaminated(make(rows), benchmark).collect()]
    assert sorted(kept, key=repr) == sorted([(1, b), (None, b), (2, c)], key=repr)
