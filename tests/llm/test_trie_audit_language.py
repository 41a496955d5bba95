"""Operators 11 to 13 against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import filter_audit, language_ranks, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, path string, at int, kind int"


# ---- 11 -----------------------------------------------------------------------------------

def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), role or "", digest, text or ""))
    lists = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = lists.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_trie(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = []
    for n, who in members.items():
        under = [m for m in members if m[: len(n)] == n]
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], sum(not children[m] for m in under),
                    sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in under),
                    hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, hot=0):
    rng, rows = random.Random(seed), []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "assistant"]), "é" * rng.randrange(3)) for t in range(rng.randrange(1, 8))]
    rows += [(1000 + 7 * k, t, "user", f"same {t}") for k in range(hot) for t in range(9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows, shard_rows, head", [
    (conversations(1, 60), 4096, 256), (conversations(2, 80), 3, 256), (conversations(3, 40, 60), 7, 256), (conversations(4, 40, 30), 5, 6)])
def test_trie_equals_plain_python(spark, rows, shard_rows, head):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(5)
    got = prefix_trie.prefix_trie(df, shard_rows, head)
    assert got.columns == list(prefix_trie.COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_odd_turns(spark):
    rows = [(None, 1, "user", "nobody's"), (5, None, None, None), (5, None, "user", ""), (5, 3, "user", "b"), (5, 3, "user", "b"), (5, 3, "user", "a"), (0, 1, "u", "x"),
            (100, 0, "user", "only turn"), (199, 0, "u", "x" * 100000), (7, -400, "user", "early"), (7, 900, "user", "late")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr) == plain_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="integer"):
        prefix_trie.prefix_trie(df.withColumn("conv_id", df["conv_id"].cast("string")))


def test_one_conversation_with_most_turns(spark):
    rows = [(3, t, "user", f"turn {t}") for t in range(2000)] + conversations(5, 30)
    rows = [r for r in rows if r[0] != 3 or r[3].startswith("turn")]
    twin = rows + [(109, t, "user", f"turn {t}") for t in range(700)] + [(209, t, "user", f"turn {t}") for t in range(500)]
    for given in (rows, twin):
        df = spark.createDataFrame([(*r, "x", 1, 2) for r in given], TURNS).repartition(4)
        got = sorted(map(tuple, prefix_trie.prefix_trie(df, 10, 64).collect()), key=repr)
        assert len(got) == len(set(got)) and got == light_trie(given)


def light_trie(rows):
    """``plain_trie`` by hashes of the prefixes, for conversations of many turns."""
    convs, members, ends, up, size = rebuilt(rows), defaultdict(set), defaultdict(list), {}, {}
    for c, turns in convs.items():
        state, node = hashlib.sha256(), (0, "")
        members[node].add(c)
        for d, turn in enumerate(turns, 1):
            state.update(repr(turn).encode())
            child = (d, state.hexdigest())
            up[child], size[child], node = node, len(turn[1]), child
            members[node].add(c)
        ends[node].append(c)
    children, leaves, saved = Counter(up.values()), Counter(), Counter()
    for node in sorted(members, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * size.get(node, 0)
        if node in up:
            leaves[up[node]] += leaves[node]
            saved[up[node]] += saved[node]
    return sorted(((min(who), n[0], min(members[up[n]]) if n in up else None, len(who), children[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, who in members.items()), key=repr)


# ---- 12 -----------------------------------------------------------------------------------

def plain_audit(rows, labels):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    docs = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and first[text] < doc}
        docs.append((lang or "", fails, doc in good, doc in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), sum(d[1][f] for d in mine) - len(removed),
                                                   sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows(seed):
    rng, rows = random.Random(seed), [(None, "no id", "en"), (3, None, "en"), (4, "", None), (4, "", None), (9, "Ünï\x00 #", "xx"), (10, "ABC\x0bDEF\x1cG \x85", "xx")]
    texts = [" ".join(rng.choice(["Aa", "b", "c#", "dé", "E\n"]) + str(rng.randrange(k)) for _ in range(n)) for n, k in ((250, 9), (250, 900), (30, 5), (199, 400), (200, 400))]
    texts += [t.lower() for t in texts] + [t.replace("#", "").lower() for t in texts]
    rows += [(i, rng.choice(texts), rng.choice(["en", "de"])) for i in range(20, 160)]
    return rows, [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(10, 120)] + [(25, 1, 0), (None, 1, 1)]


@pytest.mark.parametrize("seed, shard_bytes", [(1, 8 << 20), (2, 3000)])
def test_audit_equals_plain_python(spark, seed, shard_bytes):
    rows, labels = audit_rows(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, shard int, digest string").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), shard_bytes).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == plain_audit(rows, labels) and len(got) % 600 == 0


def test_term_matrix_holds_every_word(spark, make):
    import numpy as np

    rows, _ = audit_rows(3)
    docs = make([r[:2] for r in rows])
    shards, dictionary = filter_audit.term_matrix(docs, 2000, range_words=300)
    parts = dictionary.collect()
    words = {r["first"] + i: w for r in parts for i, w in enumerate(bytes(r["words"]).split(b" "))}
    assert len(parts) > 3
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    got = Counter()
    for s in shards.collect():
        ends = [0, *np.frombuffer(s["ends"], "<i4").tolist()]
        columns, counts = np.frombuffer(s["columns"], "<i8").tolist(), np.frombuffer(s["counts"], f"<u{s['width']}").tolist()
        for i, doc in enumerate(s["doc_id"]):
            got[doc, tuple(sorted((words[c], n) for c, n in zip(columns[ends[i]: ends[i + 1]], counts[ends[i]: ends[i + 1]])))] += 1
    assert got == Counter((d, tuple(sorted(Counter((t or "").encode().split()).items()))) for d, t, _ in rows)


def test_audit_of_an_empty_table(spark, make):
    assert filter_audit.audit(make([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- 13 -----------------------------------------------------------------------------------

def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return Counter(w[i: i + n] for w in ("_" + " _ ".join(words).replace(" _ ", "_") + "_",) if words for n in (1, 2, 3) for i in range(len(w) - n + 1)
                   if w[i: i + n] != "_" and not (n == 3 and w[i + 1] == "_"))


def plain_rank(counts):
    code = lambda g: [0x110000 if c == "_" else ord(c) for c in g]
    return sorted(counts, key=lambda g: (-counts[g], len(g), code(g)))[:300]


def plain_language(rows):
    sums = defaultdict(Counter)
    for doc, text, lang in rows:
        if lang is not None and zlib.crc32(b"" if doc is None else str(doc).encode()) % 5:
            sums[lang] += plain_grams(text)
    ranks = {lang: {g: i for i, g in enumerate(plain_rank(c))} for lang, c in sums.items()}
    out = []
    for doc, text, _ in rows:
        mine = plain_rank(plain_grams(text))
        far = sorted((sum(abs(r[g] - i) if g in r else 300 for i, g in enumerate(mine)), lang) for lang, r in ranks.items())
        held = zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 0
        out.append((doc, held, *((far[0][1], 1 - far[0][0] / (300 * len(mine))) if far and mine else ("und", 0.0))))
    return sorted(out, key=repr)


def language_rows(seed):
    rng, rows = random.Random(seed), []
    syllables = {"aa": ["ka", "lo", "mi", "ß"], "bb": ["ka", "ro", "né", "ti"], "cc": ["жа", "ло", "İx", "ΑΣ"]}
    for i in range(150):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 40)))
        rows.append((i, text + rng.choice(["", "!", " 12", "\n\n"]), rng.choice([lang] * 9 + [None])))
    return rows + [(None, "kalo", "aa"), (7, None, "aa"), (8, "123 !", "bb"), (8, "", None), (9, "中" * 3, "bb"), (9, "𝒳y" * 700, "cc")]


@pytest.mark.parametrize("block", [1 << 20, 97])
def test_languages_equal_plain_python(make, monkeypatch, block):
    monkeypatch.setattr(language_ranks, "_BLOCK", block)
    from pyspark.sql import functions as F

    rows = language_rows(5)
    lang = {(d, t): l for d, t, l in rows}
    df = make([r[:2] for r in rows])
    of = F.create_map(*[F.lit(x) for (d, t), l in lang.items() for x in (f"{d}|{t}", l or "")])
    docs = df.withColumn("lang", F.nullif(of[F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.coalesce("text", F.lit("None")))], F.lit("")))
    got = language_ranks.identify(docs, language_ranks.train(docs)).collect()
    want = plain_language(rows)
    assert [tuple(r)[:3] for r in sorted(map(tuple, got), key=repr)] == [w[:3] for w in want]
    assert [r[3] for r in sorted(map(tuple, got), key=repr)] == pytest.approx([w[3] for w in want])


def test_no_language_to_learn_from(make):
    from pyspark.sql import functions as F

    docs = make([(1, "some words"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language_ranks.identify(docs, language_ranks.train(docs)).collect()} == {("und", 0.0)}
    assert language_ranks.identify(docs.limit(0), language_ranks.train(docs.limit(0))).count() == 0


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_ranks.identify(docs, language_ranks.train(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
