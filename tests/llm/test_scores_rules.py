"""Classifiers by held-out accuracy, rules and licences against plain Python, the language model against its own definition."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import fertility, license_index, pitman_yor, quality_cnn, toxicity_mil
from plumbline.llm.encoding import default_path
from test_simhash_decontamination import text


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "the", "on", "ti", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


ODD = [(9001, None), (9002, ""), (None, "no id"), (9003, "word " * 40000), (9004, "twice"), (9004, "twice")]


def labelled(rng, make_bad, label, n=320):
    rows = [(i, make_bad(rng) if i % 4 == 0 else "\n".join(prose(rng, 30) for _ in range(3))) for i in range(n)]
    return rows, [(i, int((i % 4 == 0) == (label == "toxic"))) for i in range(n)]


def test_network_gradients_are_right():
    net = quality_cnn.Network(3)
    texts, y = [b"some text with $$$ bytes " * 40, b"", b"other " * 10], np.array([1, 0, 1])
    g, _ = net.gradients(texts, y)
    for k in ("u", "c", "W", "b", "E"):
        flat = net.p[k].reshape(-1)
        i = int(np.abs(g[k].reshape(-1)).argmax())
        old, step = float(flat[i]), 1e-2 if k in "uc" else 2e-3
        losses = []
        for d in (step, -step):
            flat[i] = old + d
            losses.append(net.gradients(texts, y)[1])
        flat[i] = old
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(float(g[k].reshape(-1)[i]), rel=0.15, abs=2e-3)


def test_quality_held_out(spark, make):
    rows, labels = labelled(random.Random(1), lambda r: " ".join(w + "$$$" for w in prose(r, 60).split()), "quality")
    docs, lab = make(rows + ODD), spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, quality int")
    net = quality_cnn.train(docs, lab, steps=120)
    got = quality_cnn.score(docs, net).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [(dict(labels)[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in dict(labels)]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    kept = quality_cnn.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    # A text scores the same whatever stands beside it.
    texts = [t.encode() for _, t in rows[:20]]
    assert np.allclose(net.probabilities(texts), [net.probabilities([t])[0] for t in texts], atol=1e-5)


def test_toxicity_held_out_and_located(spark, make):
    def bad(r):
        lines = [prose(r, 12) for _ in range(6)]
        lines[r.randrange(6)] = f"{prose(r, 4)[:-1]} {r.choice(['vilething', 'vileword', 'nastyx'])} {prose(r, 3)}"
        return "\n".join(lines)

    rows, labels = labelled(random.Random(2), bad, "toxic")
    docs, lab = make(rows + ODD), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity_mil.train(docs, lab)
    got = toxicity_mil.score(docs, model).collect()
    held = [(dict(labels)[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in dict(labels)]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.98 * len(held)
    for r in got:
        if r["predicted"] and r["doc_id"] is not None:
            sentences = toxicity_mil.sentences_of(dict(rows)[r["doc_id"]])
            assert {b"vilething", b"vileword", b"nastyx"} & set(sentences[r["worst"]]) and r["worst"] in r["offending"]
    assert all(not r["predicted"] for r in got if r["doc_id"] in (9001, 9002, 9003, 9004, None))
    clean = toxicity_mil.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(1 - r["predicted"] for r in got)


@pytest.mark.parametrize("module,label", [(quality_cnn, "quality"), (toxicity_mil, "toxic")])
def test_without_labels_or_documents(spark, make, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert module.score(make(ODD), module.train(make(ODD), none)).count() == len(ODD)
    assert module.score(make([]), module.train(make([]), none)).count() == 0


def plain_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i: i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed


def test_fertility_rules(make):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randrange(1, 90))) for i in range(80)] + ODD
    again = text(rng, 12)
    rows += [(200, f"{again} {text(rng, 30)} {again}"), (201, f"{again} {again}"), (202, "l one\nl one\n \n\nl one \n"), (203, "a b " * 40), (204, "# * $ %&|<>[] x y \x85 \x1c z"), (205, "日本語 " * 30)]
    got = fertility.apply_rules(make(rows)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(((i, *plain_rules(t)) for i, t in rows), key=repr)
    assert all(not r["kept"] for r in got if r["base_failed"]) and any(r["kept"] for r in got)
    assert fertility.apply_rules(make([])).count() == 0
    assert fertility.apply_rules(make(rows).drop("lang")).count() == len(rows)


def test_fertility_measures_equal_plain_python():
    import math

    import sentencepiece
    from tokenizers import Tokenizer

    from plumbline.llm.encoding import default_path

    bpe, pieces = default_path(), default_path("piece_bpe_32k.model")
    plain, model = Tokenizer.from_file(bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
    rng = random.Random(8)
    texts = [t for _, t in ODD] + [text(rng, n) for n in (1, 30, 90)] + ["two  spaces\n\nand lines ", "日本語 ひら\u00a0がな", "ж 😀😀 x", "<|endoftext|> a"]
    for t, row in zip(texts, fertility.measure(texts, bpe, pieces)):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        words = [w.decode() for w in (t or "").encode().split()]
        found = [p for ids_of in model.encode(words) for p in ids_of]
        counts = Counter(ids)
        assert row[5] == (sum(map(len, words)) / len(ids) if ids else 0)
        assert row[6] == (sum(map(model.is_byte, found)) / len(found) if found else 0)
        assert math.isclose(row[7], -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values()), abs_tol=1e-9)


def test_bands_lean_on_the_script_smoothly(make):
    """One document more or less moves the ends of a band a little, whatever the number."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i, " ".join(prose(rng, 10) for _ in range(6))) for i in range(120)]
    wide = [(1000, " ".join(prose(rng, 10) for _ in range(6)) + " 日本 語 ひら" * 3)]
    kept = []
    for n in (48, 49, 50, 51):
        docs = make(rows + wide).withColumn("lang", F.when(F.col("doc_id") < n, "aa").otherwise("bb"))
        kept.append(sum(r["kept"] for r in fertility.apply_rules(docs).collect()))
    assert max(kept) - min(kept) <= 1


def test_odd_language_is_outside_the_bands(make):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 10) for _ in range(6))) for i in range(150)] + [(500, " ".join("qzxjvk" + "".join(rng.choice("qzxjvkw") for _ in range(7)) for _ in range(60)))]
    got = {r["doc_id"]: r for r in fertility.apply_rules(make(rows)).collect()}
    assert not got[500]["kept"] and "chars_per_token" in got[500]["reasons"]
    assert sum(got[i]["kept"] for i in range(150)) >= 148


def test_small_groups_are_not_measured_by_others(spark, make):
    """A few Greek documents among many English ones are kept, like fifty of them; a small language uses its script's bands."""
    rng = random.Random(5)
    english = [(i, " ".join(prose(rng, 10) for _ in range(6)), "en") for i in range(150)]
    greek = [(1000 + i, " ".join("".join(rng.choice("αβγδεζηθικλμνξο") for _ in range(7)) for _ in range(60)), "el") for i in range(60)]
    odd = [(2000, " ".join("qzxjvk" + "".join(rng.choice("qzxjvkw") for _ in range(7)) for _ in range(60)), "xx")]
    for n in (5, 60):
        rows = spark.createDataFrame(english + greek[:n] + odd, "doc_id long, text string, lang string")
        for docs in (rows, rows.drop("lang")):
            got = {r["doc_id"]: r for r in fertility.apply_rules(docs).collect()}
            assert sum(got[1000 + i]["kept"] for i in range(n)) >= n - 1 and not got[2000]["kept"]


def test_license_scan(make):
    filler = "some words before it"
    rows = [(1, f"{filler}. Licensed under the Apache License, Version 2.0. more"), (2, "All rights reserved. ALL RIGHTS RESERVED!"), (3, f"{filler} CC BY and cc-by"),
            (4, "GNU General Public License"), (5, "the license of rights under general conditions"), (6, None), (7, ""), (None, "all rights reserved"),
            (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
            (9, "all all rights reserved rights"), (10, "Redistribution of goods in binary forms"), (2, "x")]
    got = {(r["doc_id"], r["n_words"]): r for r in license_index.scan(make(rows)).collect()}
    by = lambda i: next(r for (d, _), r in got.items() if d == i)
    assert len(got) == len(rows)
    assert by(1)["labels"] == "apache-2.0" and by(1)["base_labels"] == "" and by(1)["first_word"] is None and by(1)["score"] >= 0.75
    assert (got[2, 6]["n_base"], got[2, 6]["first_word"], got[2, 6]["last_word"]) == (2, 0, 3)
    assert (by(3)["n_base"], by(3)["first_word"], by(3)["last_word"], by(3)["base_labels"]) == (2, 4, 7, "cc-by")
    assert by(4)["base_labels"] == "gpl" and by(4)["first_word"] == 1
    assert [by(i)["labels"] for i in (5, 6, 7, 10)] == [""] * 4 and all(by(i)["score"] == 0 for i in (5, 6, 7, 10))
    assert by(8)["labels"] == "mit" and by(9)["first_word"] == 1 and by(None)["n_base"] == 1
    assert license_index.scan(make([])).count() == 0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    return [(i, text(rng, rng.randrange(1, 120))) for i in range(150)] + [(900, None), (901, ""), (902, "unseen words only here"), (None, "no id"), (7, "again"), (7, "again")]


def test_base_scores_equal_plain_counts(make, corpus):
    got = pitman_yor.score_documents(make(corpus), tokens_per_part=2000, hot_words=30).collect()
    counts = Counter()
    for i, t in corpus:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(pitman_yor.tokens_of(t))
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t in corpus:
        w = pitman_yor.tokens_of(t)
        want.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), total,
                     round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), 8)))
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 8)) for r in got), key=repr) == sorted(want, key=repr)
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_parts_and_hot_words_do_not_change_what_is_learnt(make, corpus):
    one = pitman_yor.score_documents(make(corpus), sweeps=0, hot_words=0, tokens_per_part=10**9)
    many = pitman_yor.score_documents(make(corpus), sweeps=0, hot_words=0, tokens_per_part=50)
    rows = lambda df: sorted(((r["doc_id"], r["n_tokens"], round(r["score"], 8)) for r in df.collect()), key=repr)
    assert rows(one) == rows(many)


def test_probabilities_add_up_to_one(make, corpus):
    """Over the vocabulary and one unknown word, in every context, for the hot words and the others together."""
    model = pitman_yor.fit(make(corpus), tokens_per_part=2000, hot_words=30)
    mass = (10 ** model.hot_dishes).sum(axis=0)
    words = len(model.hot)
    for r in model.states.collect():
        s = pitman_yor.Seating.load(r["state"])
        tops, dishes = s.probabilities(model.samples)
        words += len(s.hashes)
        for u in range(pitman_yor.CONTEXTS):
            p = sum(t.in_context(0, 0, np.full(len(s.hashes), u), top) for t, top in zip(model.samples, tops)) / len(model.samples)
            own = s.context == u
            p[s.word[own]] = dishes[own]
            mass[u] += p.sum()
    assert words == model.vocabulary
    unknown = sum(t.in_context(0, 0, np.arange(pitman_yor.CONTEXTS), np.full(pitman_yor.CONTEXTS, t.top(0, 0))) for t in model.samples) / len(model.samples)
    assert np.allclose(mass + unknown, 1, atol=1e-9)


@pytest.mark.parametrize("discount", [0.2, 0.5, 0.9])
@pytest.mark.parametrize("customers, weight", [(2, 0.3), (5, 0.1), (10, 0.05), (30, 1.0), (60, 20.0)])
@pytest.mark.parametrize("exact", [256, 1])
def test_tables_follow_their_law(monkeypatch, customers, weight, discount, exact):
    """Mean and variance against the law, for direct draws and for proposals: ways[t] * weight ** t by the plain recursion."""
    ways = {1: 1.0}
    for c in range(1, customers):
        ways = {t: ways.get(t - 1, 0) + (c - discount * t) * ways.get(t, 0) for t in range(1, c + 2)}
    law = np.array([ways[t] * weight ** t for t in range(1, customers + 1)])
    law /= law.sum()
    mean = float((law * np.arange(1, customers + 1)).sum())
    spread = float((law * (np.arange(1, customers + 1) - mean) ** 2).sum())
    draw = np.random.default_rng(1)
    t = pitman_yor.seat(np.full(6000, customers), np.ones(6000, np.int64), np.full(6000, weight), discount, draw)
    if exact == 1:  # proposals leave the law as it is
        monkeypatch.setattr(pitman_yor, "EXACT_SEATS", exact)
        t, before = pitman_yor.seat(np.full(6000, customers), t, np.full(6000, weight), discount, draw), t
        assert (t != before).any()
    assert t.min() >= 1 and t.max() <= customers
    assert abs(t.mean() - mean) < 0.03 + 4 * math.sqrt(spread / 6000) and abs(t.var() - spread) < 0.03 + 0.12 * spread


def test_no_customers_no_tables():
    assert pitman_yor.seat(np.array([0, 1]), np.ones(2, np.int64), np.ones(2), 0.5, np.random.default_rng(1)).tolist() == [0, 1]


def test_every_preceding_word_has_a_restaurant(make):
    """300 words, each followed by one of its own: only contexts of all 300 tell what follows."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"a{k} b{k}" for k in (rng.randrange(300) for _ in range(60)))) for i in range(150)]
    for settings in ({"hot_words": 30}, {}):
        got = [r for r in pitman_yor.score_documents(make(rows), tokens_per_part=2000, **settings).collect() if r["held_out"]]
        assert sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got) > -1.6


def test_no_documents(make):
    assert pitman_yor.score_documents(make([])).count() == 0
    assert default_path().endswith(".json")


def test_far_blocks_are_merged_in_little_memory():
    import tracemalloc

    rng, heads, want = np.random.default_rng(1), [], Counter()
    for _ in range(20):
        contexts, words = (np.unique(rng.integers(0, 3 * n, n).astype(np.uint64)) for n in (1500, 2500))
        n = rng.integers(1, 9, len(contexts))
        word, trained = rng.integers(0, len(words), n.sum()), rng.integers(0, 3, n.sum())
        heads.append(pitman_yor.packed(contexts, n.astype("u4"), words, word.astype("u4"), trained.astype("u4")))
        for c, w, t in zip(np.repeat(contexts, n).tolist(), words[word].tolist(), trained.tolist()):
            want[c, w] += t
    entries = sum(len(pitman_yor.unpacked(h)[3]) for h in heads)
    tracemalloc.start()
    far = pitman_yor.FarSeating.begin(iter(heads))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(zip(far.contexts[far.context].tolist(), far.words[far.word].tolist()), far.customers.tolist())) == dict(want)
    assert peak < 90 * entries  # bytes; all blocks unpacked at once took more than 110


def test_packed_arrays_come_back_and_sorted_hashes_take_less():
    import numpy as np
    from plumbline.llm import pitman_yor

    draw = np.random.default_rng(3)
    hashes = draw.integers(0, 1 << 64, 20_000, np.uint64, endpoint=False)
    arrays = [hashes, np.sort(hashes), np.zeros(0, np.uint64), np.arange(7, dtype="u4")[::-2], draw.random(5), np.array([255], "u1")]
    back = pitman_yor.unpacked(pitman_yor.packed(*arrays))
    assert all(a.dtype == b.dtype and np.array_equal(a, b) for a, b in zip(arrays, back, strict=True))
    (last,) = pitman_yor.unpacked(pitman_yor.packed(*arrays), 5)
    assert last.tolist() == [255]
    assert len(pitman_yor.packed(arrays[1])) < 7 * len(hashes) < len(pitman_yor.packed(hashes))
    assert len(pitman_yor.packed(draw.integers(0, 60_000, 50_000).astype("u4"))) < 2.1 * 50_000


def test_blocks_are_not_kept_and_merged_heads_count_all(make, corpus, monkeypatch):
    kept, stored = [], pitman_yor.stored
    monkeypatch.setattr(pitman_yor, "stored", lambda df, purpose, **options: kept.append(purpose) or stored(df, purpose, **options))
    assert pitman_yor.score_documents(make(corpus), sweeps=1, tokens_per_part=2000, hot_words=30).count() == len(corpus)
    assert set(kept) == {"words", "seating"}
    rng, heads, want = np.random.default_rng(2), [], Counter()
    for _ in range(5):
        h = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        n = rng.integers(1, 5, len(h))
        ctx = np.concatenate([np.sort(rng.choice(pitman_yor.CONTEXTS, k, replace=False)) for k in n])
        trained = rng.integers(0, 3, n.sum())
        heads.append(pitman_yor.packed(h, n.astype("u1"), ctx.astype("u1"), trained.astype("u4")))
        for word, c, t in zip(np.repeat(h, n).tolist(), ctx.tolist(), trained.tolist()):
            want[word, c] += t
    h, n, ctx, trained = pitman_yor.unpacked(pitman_yor.merged_heads(heads))
    assert dict(zip(zip(np.repeat(h, n).tolist(), ctx.tolist()), trained.tolist())) == {k: t for k, t in want.items() if t}


def test_words_are_numbered_as_they_are_split():
    texts = ["", None, "One  two\tTWO", " x\x0by\x0c", "\u00c4b\u00a0c one", "one", "  ", "", "z\x1cz\r\n"]
    for start in range(len(texts)):  # also of a slice, whose buffers begin earlier
        h, ids, lengths = pitman_yor.numbered(pa.array(texts, pa.string()).slice(start))
        split = [pitman_yor.tokens_of(t) for t in texts[start:]]
        assert lengths.tolist() == [len(words) for words in split] and len(set(h.tolist())) == len(h)
        assert h[ids].tolist() == pitman_yor.hashes_of([w for words in split for w in words]).tolist()
    assert pitman_yor.numbered(pa.array([], pa.string()))[1].tolist() == []


def test_alike_restaurants_count_once():
    c, t = np.array([5, 1, 3, 5, 0, 1, 1 << 33]), np.array([2, 1, 1, 2, 0, 1, 9])
    one = [pitman_yor.strength_evidence(c[i:i + 1], t[i:i + 1], 0.4) for i in range(len(c))]
    assert np.abs(pitman_yor.strength_evidence(c, t, 0.4) - sum(one)).max() <= len(c)


def test_replies_between_sweeps_hold_the_newest_counts_only():
    word = np.zeros(1, np.int64)
    seating = pitman_yor.Seating.begin(np.array([7], np.uint64), word, word, word + 3, word + 2, word + 5)
    asked = pitman_yor._frame([(0, pitman_yor.FIXED, 1, pitman_yor.packed(np.array([7], np.uint64), np.array([2], "u4")), None)])
    for scoring, expected in ((False, [[3], [1]]), (True, [[5], [3], [1], [3], [1]])):
        rows = pitman_yor._near_rows(0, seating, asked, scoring)
        (reply,) = pitman_yor._of_kind(rows, pitman_yor.SENT).values()
        assert [x.tolist() for x in pitman_yor.unpacked(reply)] == expected
