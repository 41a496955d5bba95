"""Shards, sequences and token files: laws that must hold, optimal capacities, and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from plumbline.llm import encoding, minimax_shards, packing, token_files
from test_simhash_decontamination import text


def smallest_capacity(sizes, shards):
    def fits(c):
        n, load = 1, 0
        for s in sizes:
            if s > c:
                return False
            if load + s > c:
                n, load = n + 1, 0
            load += s
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def check_shards(rows, got, shards):
    import hashlib

    groups = {}
    for _, t in rows:
        key = hashlib.sha256((t or "").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 8
    capacity = smallest_capacity([groups[k] for k in sorted(groups)], shards)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    loads, slots, where = {}, {}, {}
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None and r["capacity"] == capacity
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert max(loads.values()) == capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return loads


@pytest.mark.parametrize("level,slice_rows", [(3, 200_000), (1, 7)])
def test_minimax_capacity_is_optimal(make, level, slice_rows):
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randrange(1, 60))) for i in range(400)] + [(500, None), (501, ""), (None, "no id"), (3, "again"), (3, "again")]
    check_shards(rows, minimax_shards.shard_documents(make(rows), slice_rows=slice_rows, level=level).collect(), 24)


@pytest.mark.parametrize("copies", [("copied text ",), ("another ",), ("third ",), ("fourth ",), ("copied text ", "another "), ("x", "third ", "y")])
def test_huge_groups_leave_the_others_even(make, copies):
    rng = random.Random(4)
    rows = [(i, copies[i % len(copies)] * 20) for i in range(300)] + [(i, text(rng, 20)) for i in range(300, 900)]
    got = minimax_shards.shard_documents(make(rows), slice_rows=50).collect()
    loads = check_shards(rows, got, 24)
    huge = {r["shard"] for r in got if (r["doc_id"] or 0) < 300}
    others = sorted(n for s, n in loads.items() if s not in huge)
    assert len(loads) == 24 and others[-1] < 2 * others[0]


def test_equal_rows_are_numbered_apart(make, monkeypatch):
    monkeypatch.setattr(minimax_shards, "RUN", 7)
    rows = [(1, "the same row")] * 100 + [(None, "the same row")] * 50 + [(i, f"text {i}") for i in range(30)]
    check_shards(rows, minimax_shards.shard_documents(make(rows), 5, 10).collect(), 5)


def test_few_or_no_groups(make):
    assert minimax_shards.shard_documents(make([])).count() == 0
    got = minimax_shards.shard_documents(make([(1, "a"), (2, "bb"), (3, "a")])).collect()
    check_shards([(1, "a"), (2, "bb"), (3, "a")], got, 24)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_places_every_piece_once(lengths):
    counts = {s: lengths.count(s) for s in set(lengths)}
    plan = packing.Plan(counts, 64)
    size = np.array(sorted(lengths), np.int64)
    rank = np.array([i for s in sorted(counts) for i in range(counts[s])], np.int64)
    if not len(size):
        assert plan.sequences == 0
        return
    sequence, offset = plan.place(size, rank)
    assert set(sequence.tolist()) == set(range(plan.sequences))
    for q in range(plan.sequences):
        own = sorted(zip(offset[sequence == q].tolist(), size[sequence == q].tolist()))
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
    assert plan.sequences <= max(-(-sum(lengths) // 64), 1) * 1.5 + 1


def encoded(rows):
    e = encoding.encoder(encoding.default_path())
    return [(i, [*x.ids, 2]) for (i, _), x in zip(rows, e.tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ROWS = [(5, "Hello world, it's  two spaces"), (1, None), (2, ""), (9, " lead and trail "), (7, "tab\t and\n lines   x"), (8, "word " * 3000 + "end"),
        (3, "日本語 テスト <|endoftext|> x"), (3, "same id"), (3, "same id"), (None, "no id"), (11, "a" * 1023 + " b")]


def test_pieces_and_sequences(make):
    rng = random.Random(8)
    rows = ROWS + [(100 + i, text(rng, rng.randrange(1, 700))) for i in range(60)]
    got = packing.pack(make(rows), slice_rows=5).collect()
    want = []
    for i, ids in encoded(rows):
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
    assert len(by) <= -(-sum(w[3] for w in want) // 1024) + 2
    assert packing.pack(make([])).count() == 0


def test_round_trip(make):
    got = token_files.round_trip(make(ROWS), frame_tokens=50).drop("file").collect()
    want, at = [], 0
    key = {i: k for k, i in enumerate([None, 1, 2, 3, 5, 7, 8, 9, 11])}
    lengths = sorted(((key[i], len(ids)) for i, ids in encoded(ROWS)))
    assert sorted((tuple(r)[0], tuple(r)[2], tuple(r)[3]) for r in got if r[0] is not None) == sorted((i, len(ids), crc(ids)) for i, ids in encoded(ROWS) if i is not None)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        want.append((key[r["doc_id"]], r["n_tokens"]))
    assert [w[0] for w in want] == [k for k, _ in lengths]
    assert token_files.round_trip(make([])).count() == 0


def test_random_access_and_damage(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.zst")
    writer = token_files.Writer(fs.LocalFileSystem().open_output_stream(path, compression=None), 100)
    docs = [(i * 3, list(range(i, i + i % 37 + 1))) for i in range(200)]
    for i, ids in docs:
        writer.add(i, np.array(ids, "<u4").tobytes())
    writer.close()
    with fs.LocalFileSystem().open_input_file(path) as file:
        reader = token_files.Reader(file)
        assert len(reader.table) > 20
        assert reader.find(300) == [100] and reader.ids(100).tolist() == docs[100][1] and reader.frames_read == 1
    raw = bytearray(open(path, "rb").read())
    import io
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(raw)), read_across_frames=True).read()
    assert plain == b"".join(np.array(ids, "<u4").tobytes() for _, ids in docs)  # other readers skip the tail
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with fs.LocalFileSystem().open_input_file(path) as file, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(file).ids(0)


def test_word_memory_gives_the_library_ids():
    e = encoding.Encoder(encoding.default_path())
    rng = random.Random(1)
    texts = [t or "" for _, t in ROWS] + [text(rng, 50) for _ in range(20)] + ["", " ", "  ", "\n", "a  b", "x \ny", "don't won't 'll", "é" * 50 + " " + "ß" * 60]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.ids(texts) == want and e.ids(texts) == want
    e.memory.limit = 4000  # words are forgotten and learned again
    for _ in range(3):
        for lo in range(0, len(texts), 5):
            assert e.ids(texts[lo: lo + 5]) == want[lo: lo + 5] and e.memory.words.nbytes < 60_000


def test_added_tokens_are_those_of_the_plain_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoding.default_path())
    e = encoding.Encoder(encoding.default_path())
    texts = ["foo <|endoftext|> bar", "a<|endoftext|>b c", "<|endoftext|>", "x <|endoftext|>", "two  spaces <|endoftext|>\n", "plain words only", "<|endof text|>"]
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert e.ids(texts) == want and e.ids(texts) == want
