"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling over the whole training corpus.

Restaurants: one for each context of a word (the preceding word, whichever it is, or the beginning of the text),
which share one parent, the restaurant of all words, whose own parent is uniform over the vocabulary and one
unknown word. Customers are word occurrences; the tables of a context's restaurant
are the customers of the parent. A Gibbs sweep seats the customers of every dish in a restaurant anew: the number of
tables is drawn from its law given all other dishes, which is proportional to the ways to seat the customers at so many
tables (generalised Stirling numbers) times the weight of a new table, (strength + discount * all tables) * parent
probability, to that power. Restaurant totals are those of the sweep before. Each sweep draws the strength of the context
restaurants from its law over a grid; discounts follow from the dishes with one and two customers. Predictive
probabilities are averaged over the last sweeps.

How it is spread: a first pass counts words. Contexts are near (the beginning, and the ``OWN_CONTEXTS`` most frequent
words, whose restaurants are spread over all parts) or far (every other word). The near dishes of the ``HOT`` most
frequent words have dense tables of fixed size, sampled on the driver and sent to all tasks; those of every other word
belong to one of many parts by the word's hash, so that no part is ruled by one word. A far restaurant lies whole in
one far part, by the context's hash. In a sweep the far parts send each word's tables to the word's part, which seats
the parent restaurant and replies with its counts. A second pass turns blocks of documents into packed arrays, one row
per block and part, from which each part counts its dishes; a third pass, once all are seated, packs the blocks again for
scoring, as keeping them would take more disk than the texts. Texts are never shuffled. Words are known by 64-bit hashes.

Inputs: a null or empty text is one end token. Rows are scored one by one, also when ids repeat or are null (a null
id counts as the empty id for the split). Extra columns are ignored. Without training tokens every probability
is one, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import LOWER_BYTES, discard, encoded, remainder, slices, stored, tidied, tidy

MODULUS, LEFT_OUT = 7, 2
HOT = 4096
#: Near contexts: beginning of a text, and this many of the most frequent words. FAR stands for all other words, each
#: with a restaurant of its own in a far part; as a near context it has no customers.
OWN_CONTEXTS = 62
START, FAR = 0, 1
CONTEXTS = OWN_CONTEXTS + 2
SWEEPS, AVERAGED = 6, 2
STRENGTH = 1.0
#: Customers of a dish up to which its tables are drawn from their law; proposals in a sweep for a larger one.
EXACT_SEATS, PROPOSALS = 256, 4
#: Strengths of the context restaurants among which each sweep draws.
GRID = tuple(4.0 ** k for k in range(-2, 10))
BLOCK_BYTES = 6 << 20
TOKENS_PER_PART = 8_000_000
#: Far parts for each part.
FAR_PARTS = 3
HELD_WORDS = 300_000
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
SEED = 5


def tokens_of(text: str | None) -> list[bytes]:
    """Words, then the end token, which is the empty word."""
    return [*encoded(text).translate(LOWER_BYTES).split(), b""]


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, each token's place among them, and the number of tokens of each text; tokens as in ``tokens_of``."""
    texts = pa.compute.fill_null(texts, "").cast(pa.binary())
    ends = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset)
    first, ends = int(ends[0]), ends[1:] - ends[0]
    raw = texts.buffers()[2].slice(first, int(ends[-1])).to_pybytes() if len(ends) and ends[-1] else b""
    data = np.frombuffer(raw.translate(LOWER_BYTES), "u1")
    # The words lie without gaps once spaces are gone, so their starts are the offsets of an array of words.
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[ends < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, ends)
    place = np.zeros(len(data) + 1, np.int32)
    np.cumsum(inside, out=place[1:])
    offsets = np.append(place[np.insert(starts, before, ends)], place[-1])
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    _, offsets, raw = words.dictionary.buffers()
    edges, raw = np.frombuffer(offsets, "<i4", len(words.dictionary) + 1).tolist(), raw.to_pybytes() if raw else b""
    return hashes_of([raw[a:b] for a, b in zip(edges, edges[1:])]), words.indices.to_numpy().astype(np.int64), np.diff(before, prepend=0) + 1


def packed(*arrays: np.ndarray) -> bytes:
    """Compressed: of 64-bit hashes the steps from one to the next, of all numbers first the lowest bytes, then the next ones."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], "<i8").tobytes()
    steps = (np.diff(a, prepend=np.uint64(0)) if a.dtype == np.uint64 else np.ascontiguousarray(a) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.view("u1").reshape(len(a), a.dtype.itemsize).T.tobytes() for a in steps))


def unpacked(blob: bytes, *wanted: int) -> list[np.ndarray]:
    """The arrays, or those of these numbers."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 1 + 2 * count)[1:], 8 + 16 * count, []
    for i, (char, n) in enumerate(head.reshape(-1, 2).tolist()):
        kind = np.dtype(chr(char))
        if not wanted or i in wanted:
            own = np.frombuffer(raw, "u1", n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n)
            out.append(np.cumsum(own, dtype=np.uint64) if kind == np.uint64 else own)
        at += n * kind.itemsize
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.tolist()), float, len(x))


@functools.lru_cache(maxsize=4)
def log_ways(discount: float, most: int = EXACT_SEATS) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat c customers at t tables, by [c, t]."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1] = np.logaddexp(np.concatenate(([-np.inf], out[c, :-1])), stay)
    return out


def seat(customers: np.ndarray, tables: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """New numbers of tables of each dish, given all others; ``weight`` is that of a new table.

    The probability of t tables is proportional to the ways to seat the customers at them times weight ** t. Up to
    ``EXACT_SEATS`` customers it is drawn from directly; a larger dish moves by proposals from a restaurant of its own, in
    which the ways cancel. No customers, no tables.
    """
    out = (customers > 0).astype(np.int64)
    discount = min(max(discount, 1e-3), 1 - 1e-9)
    few = np.nonzero((customers > 1) & (customers <= EXACT_SEATS))[0]
    few = few[np.argsort(customers[few], kind="stable")]
    log_w, edges = np.log(weight), np.flatnonzero(np.diff(customers[few], prepend=0))
    ways = log_ways(round(discount, 6), EXACT_SEATS) if len(few) else None
    for a, b in zip(edges, [*edges[1:], len(few)]):
        c = int(customers[few[a]])
        t = np.arange(1, c + 1)
        for lo in range(a, b, max(1, (1 << 20) // c)):
            own = few[lo: min(b, lo + max(1, (1 << 20) // c))]
            law = ways[c, 1: c + 1] + t * log_w[own, None]
            mass = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (mass < draw.random(len(own))[:, None] * mass[:, -1:]).sum(axis=1)
    many = np.nonzero(customers > EXACT_SEATS)[0]
    if len(many):
        c, w, t = customers[many], weight[many], np.clip(tables[many], 1, customers[many])
        strength = np.maximum(w - discount * np.minimum(c, w * np.log1p(c / w) + 1), 1e-3)
        for _ in range(PROPOSALS):
            new = _open_tables(c, strength, discount, draw)
            gain = (new - t) * (np.log(w) - math.log(discount)) + _lgamma(strength / discount + t) - _lgamma(strength / discount + new)
            t = np.where(np.log(draw.random(len(c)) + 1e-300) < gain, new, t)
        out[many] = t
    return out


def _open_tables(customers: np.ndarray, strength: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables that restaurants of these strengths have after so many customers."""
    tables, at, who = np.ones(len(customers), np.int64), np.ones(len(customers), np.int64), np.arange(len(customers))
    while len(who):
        # Between two new tables the odds are those of an urn, so the wait is geometric with a beta-distributed chance.
        chance = np.maximum(draw.beta(strength[who] + discount * tables[who], at - discount * tables[who]), 1e-15)
        at = at + np.minimum(draw.geometric(chance), 1 << 60)
        stays = at <= customers[who]
        at, who = at[stays], who[stays]
        tables[who] += 1
    return tables


def strength_evidence(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Log probability of restaurants' customers and tables under each strength of ``GRID``, in 1024ths."""
    met = tables > 0
    c, t, d = customers[met].astype(np.int64), tables[met].astype(np.int64), max(discount, 1e-3)
    if not len(c):
        return np.zeros(len(GRID), np.int64)
    # Restaurants alike count once; both numbers as one, as sorting rows of two takes far longer.
    step = int(t.max()) + 1
    pairs, n = np.unique(c * step + t, return_counts=True)
    c, t = (x.astype(float) for x in np.divmod(pairs, step))
    logs = [_lgamma(s / d + t) - math.lgamma(s / d + 1) + (t - 1) * math.log(d) - _lgamma(s + c) + math.lgamma(s + 1) for s in GRID]
    return np.array([round(1024 * float((n * x).sum())) for x in logs], np.int64)


@dataclass
class Totals:
    """Sums over all words: customers and tables of each context, customers and tables of the parent."""

    vocabulary: int
    customers: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS, np.int64))
    tables: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS, np.int64))
    top_customers: int = 0
    top_tables: int = 0
    discount: float = 0.5
    top_discount: float = 0.5
    strength: float = STRENGTH

    def top(self, customers, tables):
        """Probability of words in the parent restaurant."""
        new = (STRENGTH + self.top_discount * self.top_tables) / (self.vocabulary + 1)
        return (np.maximum(customers - self.top_discount * tables, 0) + new) / (STRENGTH + self.top_customers)

    def new_table(self, contexts: np.ndarray, top: np.ndarray) -> np.ndarray:
        return (self.strength + self.discount * self.tables[contexts]) * top

    def in_context(self, customers, tables, contexts, top):
        return (np.maximum(customers - self.discount * tables, 0) + self.new_table(contexts, top)) / (self.strength + self.customers[contexts])


@dataclass
class Seating:
    """Near dishes (word, context) with customers and tables, and the words' tables in the parent restaurant.

    ``word`` indexes the sorted ``hashes``; dishes are sorted by (word, context). ``outer`` are the words' tables in
    far restaurants, ``count`` their training occurrences."""

    hashes: np.ndarray
    word: np.ndarray
    context: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    top_tables: np.ndarray
    old_tables: np.ndarray
    old_top_tables: np.ndarray
    outer: np.ndarray
    old_outer: np.ndarray
    count: np.ndarray

    @classmethod
    def begin(cls, hashes, word, context, customers, outer, count) -> Seating:
        one = np.ones(len(word), np.int64)
        top = np.ones(len(hashes), np.int64)
        return cls(hashes, word, context, customers, one, top, one, top, outer, outer, count)

    @classmethod
    def load(cls, blob: bytes) -> Seating:
        hashes, counts, context, *rest = unpacked(blob)
        word = np.repeat(np.arange(len(hashes)), counts)
        return cls(hashes, word, context.astype(np.int64), *(x.astype(np.int64) for x in rest))

    def dump(self) -> bytes:
        return packed(self.hashes, np.bincount(self.word, minlength=len(self.hashes)).astype("u1"), self.context.astype("u1"),
                      *(x.astype("u4") for x in (
                          self.customers, self.tables, self.top_tables, self.old_tables, self.old_top_tables, self.outer, self.old_outer, self.count)))

    def top_customers(self, old: bool = False) -> np.ndarray:
        near = np.bincount(self.word, self.old_tables if old else self.tables, len(self.hashes)).astype(np.int64)
        return near + (self.old_outer if old else self.outer)

    def sweep(self, totals: Totals, outer: np.ndarray, draw: np.random.Generator) -> Seating:
        top = totals.top(self.top_customers(), self.top_tables)
        weight = totals.new_table(self.context, top[self.word])
        tables = seat(self.customers, self.tables, weight, totals.discount, draw)
        above = np.bincount(self.word, tables, len(self.hashes)).astype(np.int64) + outer
        share = np.full(len(above), (STRENGTH + totals.top_discount * totals.top_tables) / (totals.vocabulary + 1))
        return Seating(self.hashes, self.word, self.context, self.customers, tables,
                       seat(above, self.top_tables, share, totals.top_discount, draw), self.tables, self.top_tables, outer, self.outer, self.count)

    def sums(self) -> np.ndarray:
        """Customers and tables by context, parent customers and tables, dishes and words with one and two customers."""
        above = self.top_customers()
        by = lambda w: np.bincount(self.context, w, CONTEXTS).astype(np.int64)
        return np.concatenate([by(self.customers), by(self.tables), [
            above.sum(), self.top_tables.sum(), (self.customers == 1).sum(), (self.customers == 2).sum(), (above == 1).sum(), (above == 2).sum()]]).astype(np.int64)

    def probabilities(self, samples: list[Totals]) -> tuple[list[np.ndarray], np.ndarray]:
        """Per sample the words' parent probabilities; and the dishes' probabilities averaged over the samples."""
        states = [(self.old_tables, self.old_top_tables, True), (self.tables, self.top_tables, False)][-len(samples):]
        tops, dishes = [], np.zeros(len(self.word))
        for totals, (tables, top_tables, old) in zip(samples, states):
            top = totals.top(self.top_customers(old), top_tables)
            tops.append(top)
            dishes += totals.in_context(self.customers, tables, self.context, top[self.word]) / len(samples)
        return tops, dishes


@dataclass
class FarSeating:
    """Dishes (context, word) of the far restaurants of a part, also those only met outside training (no customers).

    ``context`` and ``word`` index the sorted hashes; dishes are sorted by (context, word)."""

    contexts: np.ndarray
    words: np.ndarray
    context: np.ndarray
    word: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    old_tables: np.ndarray

    @classmethod
    def begin(cls, heads: Iterator[bytes]) -> FarSeating:
        """One block is unpacked at a time; a dish of a block is held as two numbers."""
        heads = list(heads)
        contexts, words = (np.unique(np.concatenate([unpacked(blob, i)[0] for blob in heads])) for i in (0, 2))
        keys, trained = [], []
        for blob in heads:
            before, counts, after, word, n = unpacked(blob)
            keys.append(np.repeat(np.searchsorted(contexts, before), counts) * len(words) + np.searchsorted(words, after)[word])
            trained.append(n.copy())
        keys, trained = np.concatenate(keys), np.concatenate(trained)
        order = np.argsort(keys)
        keys, trained = keys[order], trained[order]
        del order
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        key, customers = keys[first], np.add.reduceat(trained, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        tables = (customers > 0).astype(np.int64)
        return cls(contexts, words, key // len(words), key % len(words), customers, tables, tables)

    @classmethod
    def load(cls, fixed: bytes, tables: bytes) -> FarSeating:
        contexts, counts, words, word, customers = unpacked(fixed)
        return cls(contexts, words, np.repeat(np.arange(len(contexts)), counts), word.astype(np.int64), customers.astype(np.int64),
                   *(x.astype(np.int64) for x in unpacked(tables)))

    def fixed(self) -> bytes:
        return packed(self.contexts, np.bincount(self.context, minlength=len(self.contexts)).astype("u4"), self.words,
                      self.word.astype("u4"), self.customers.astype("u4"))

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, len(self.words)).astype(np.int64)

    def totals(self, totals: Totals, tables: np.ndarray) -> Totals:
        """Those of the sweep, with this part's restaurants as contexts."""
        by = lambda w: np.bincount(self.context, w, len(self.contexts)).astype(np.int64)
        return replace(totals, customers=by(self.customers), tables=by(tables))

    def sweep(self, totals: Totals, top: np.ndarray, draw: np.random.Generator) -> FarSeating:
        weight = self.totals(totals, self.tables).new_table(self.context, top[self.word])
        return replace(self, tables=seat(self.customers, self.tables, weight, totals.discount, draw), old_tables=self.tables)

    def probabilities(self, samples: list[Totals], tops: list[np.ndarray]) -> np.ndarray:
        """The dishes' probabilities averaged over the samples; ``tops`` are the words' parent probabilities."""
        out = np.zeros(len(self.word))
        for totals, tables, top in zip(samples, (self.old_tables, self.tables)[-len(samples):], tops):
            out += self.totals(totals, tables).in_context(self.customers, tables, self.context, top[self.word]) / len(samples)
        return out


def totals_of(sums: np.ndarray, vocabulary: int) -> Totals:
    n1, n2, m1, m2 = sums[2 * CONTEXTS + 2:].tolist()
    share = lambda a, b: min(1 - 1e-4, a / (a + 2 * b)) if a + b else 0.5
    return Totals(vocabulary, sums[:CONTEXTS], sums[CONTEXTS: 2 * CONTEXTS], int(sums[2 * CONTEXTS]), int(sums[2 * CONTEXTS + 1]),
                  share(n1, n2), share(m1, m2))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == LEFT_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): occurrences of each word, the end token included, in the training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            h, at = np.unique(h, return_inverse=True)
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.bincount(at, n, len(h)).astype(np.int64))], names=["h", "n"])

        for whole in batches:
            batch = whole.filter(pa.compute.invert(pa.compute.fill_null(whole.column(0), False)))
            for cut in slices(batch, "text", BLOCK_BYTES):
                h, ids, _ = numbered(cut.column(1))
                held.append((h, np.bincount(ids, minlength=len(h))))
                if sum(len(h) for h, _ in held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return _prepared(docs).select("held_out", "text").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def rank_of(hot: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in ``hot``, or -1."""
    if not len(hot):
        return np.full(len(h), -1)
    by_hash = np.argsort(hot)
    place = np.minimum(np.searchsorted(hot, h, sorter=by_hash), len(hot) - 1)
    return np.where(hot[by_hash[place]] == h, by_hash[place], -1)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def blocks(docs: DataFrame, hot: np.ndarray, parts: int, far_parts: int, hot_sums: Callable | None = None) -> DataFrame:
    """(part, block, head, tail): packed occurrences of the words of each part in a block of documents.

    Part -2 - n has far part n, parts from ``parts`` on have the hot words in near contexts, dealt by block. ``hot`` lists
    hashes by falling frequency. Heads have what counting needs. For scoring, ``hot_sums`` makes the sums of the hot words
    of every document, which are the tail of a row with the block's documents; other tails tell where words occur."""
    counting = hot_sums is None

    def of_block(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        train, documents = ~batch.column(1).to_numpy(zero_copy_only=False), batch.num_rows
        h, ids, lengths = numbered(batch.column(2))
        rank = rank_of(hot, h)
        follows = np.where((rank >= 0) & (rank < OWN_CONTEXTS), rank + 2, FAR)
        context = np.empty(len(ids), np.int64)
        context[1:] = follows[ids[:-1]]
        context[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = START
        doc = np.repeat(np.arange(documents), lengths)
        far = context == FAR
        is_hot, is_cold = (rank[ids] >= 0) & ~far, (rank[ids] < 0) & ~far
        rows = []

        def entries(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Distinct keys, training occurrences and all occurrences of each, and their documents in that order."""
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            edge = np.concatenate(([0], np.nonzero(np.diff(key))[0] + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
            trained = np.concatenate(([0], np.cumsum(train[doc])))
            return key[edge[:-1]], np.diff(trained[edge]), np.diff(edge), doc.astype("u4")

        key, trained, n, where = entries(rank[ids[is_hot]] * CONTEXTS + context[is_hot], doc[is_hot])
        slice_ = parts + ((number >> 32) + number) % parts
        rows.append((slice_, packed(key.astype("u4"), trained.astype("u4")), None) if counting else (slice_, None, hot_sums(key, n, where, documents)))
        # Cold words in the order of (part, hash), so each part is a range of word numbers.
        own_part = part_of(h, parts)
        order = np.lexsort((h, own_part))
        turn = np.empty(len(h), np.int64)
        turn[order] = np.arange(len(h))
        key, trained, n, where = entries(turn[ids[is_cold]] * CONTEXTS + context[is_cold], doc[is_cold])
        word, ctx, ends = key // CONTEXTS, key % CONTEXTS, np.concatenate(([0], np.cumsum(n)))
        cuts = np.searchsorted(own_part[order][word], np.arange(parts + 1))
        for part in range(parts):
            a, b = cuts[part], cuts[part + 1]
            if a < b:
                own, count = np.unique(word[a:b], return_counts=True)
                rows.append((part, packed(h[order][own], count.astype("u1"), ctx[a:b].astype("u1"), *[trained[a:b].astype("u4")] * counting),
                             None if counting else packed(n[a:b].astype("u4"), where[ends[a]: ends[b]])))
        # Far occurrences by (far part of the preceding word, its hash, word).
        far_part, by_hash = part_of(h, far_parts), np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[by_hash] = np.arange(len(h))
        order = np.lexsort((h, far_part))
        turn[order] = np.arange(len(h))
        at = np.nonzero(far)[0]
        key, trained, n, where = entries(turn[ids[at - 1]] * len(h) + ids[at], doc[at])
        before, word, ends = key // max(len(h), 1), key % max(len(h), 1), np.concatenate(([0], np.cumsum(n)))
        cuts = np.searchsorted(far_part[order][before], np.arange(far_parts + 1))
        for part in range(far_parts):
            a, b = cuts[part], cuts[part + 1]
            if a < b:
                own, count = np.unique(before[a:b], return_counts=True)
                words, index = np.unique(place[word[a:b]], return_inverse=True)
                rows.append((-2 - part, packed(h[order][own], count.astype("u4"), h[by_hash[words]], index.astype("u4"), *[trained[a:b].astype("u4")] * counting),
                             None if counting else packed(n[a:b].astype("u4"), where[ends[a]: ends[b]])))
        part, head, tail = zip(*rows)
        ids_of = [batch.column(0).to_pylist(), *[None] * (len(rows) - 1)]
        held = [(~train).tolist(), *[None] * (len(rows) - 1)]
        return pa.record_batch([pa.array(part, pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(head, pa.binary()), pa.array(tail, pa.binary()),
                                pa.array(ids_of, pa.list_(batch.schema.field(0).type)), pa.array(held, pa.list_(pa.bool_())),
                                pa.array([lengths.tolist(), *[None] * (len(rows) - 1)], pa.list_(pa.int64()))],
                               names=["part", "block", "head", "tail", "doc_ids", "held", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for cut in slices(batch, "text", BLOCK_BYTES):
                yield of_block(cut, number)
                number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _prepared(docs).mapInArrow(
        tidy(run), f"part int, block long, head binary, tail binary, doc_ids array<{kind}>, held array<boolean>, lengths array<long>")


def merged_hot(heads: pd.Series) -> bytes:
    """Training occurrences of the hot dishes of several blocks."""
    dense = np.zeros(HOT * CONTEXTS, np.int64)
    for blob in heads:
        key, trained = unpacked(blob)
        dense[key] += trained
    key = np.nonzero(dense)[0]
    return packed(key.astype("u4"), dense[key])


def merged_heads(heads: pd.Series) -> bytes:
    """A part's dishes in the training documents of all blocks, packed as those of one block are."""
    hashes, contexts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in heads:
        h, n, ctx, trained = unpacked(blob)
        keep = trained > 0
        hashes.append(np.repeat(h, n)[keep])
        contexts.append(ctx[keep].astype(np.int64))
        counts.append(trained[keep].astype(np.int64))
    words, word = np.unique(np.concatenate(hashes), return_inverse=True)
    key, dish = np.unique(word * CONTEXTS + np.concatenate(contexts), return_inverse=True)
    customers = np.bincount(dish, np.concatenate(counts), len(key))
    return packed(words, np.bincount(key // CONTEXTS, minlength=len(words)).astype("u1"), (key % CONTEXTS).astype("u1"), customers.astype("u4"))


def hot_counts(table: DataFrame) -> DataFrame:
    """(key, n): training occurrences of the hot dishes; at most HOT * CONTEXTS rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(HOT * CONTEXTS, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                key, trained = unpacked(blob)
                dense[key] += trained
        key = np.nonzero(dense)[0]
        yield pa.record_batch([pa.array(key), pa.array(dense[key])], names=["key", "n"])

    return table.filter("part = -1").select("state").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


#: Rows of a part: what is fixed (a far part's dishes, the words a far part asks for), the state, tables or counts sent.
_STATE = "part int, kind int, other int, state binary, sums array<long>"
FIXED, STATE, SENT = 0, 1, 2


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "other", "state", "sums"])


def _of_kind(rows: pd.DataFrame, kind: int) -> dict[int, bytes]:
    own = rows[rows["kind"] == kind]
    return dict(zip(own["other"].tolist(), own["state"]))


class FarStep:
    """The far parts' side of a sweep. Rows it sends go to the words' parts (part >= 0), its own have part -2 - n."""

    def __init__(self, hot: np.ndarray, parts: int):
        self.hot, self.parts = hot, parts

    def dealt(self, seating: FarSeating) -> Iterator[tuple[int, np.ndarray]]:
        """The cold words of each part, in the order of their hashes."""
        cold = np.nonzero(rank_of(self.hot, seating.words) < 0)[0]
        own = part_of(seating.words[cold], self.parts)
        for part in np.unique(own).tolist():
            yield part, cold[own == part]

    def rows(self, part: int, seating: FarSeating, discount: float = 0.5) -> list[tuple]:
        sent = seating.by_word(seating.tables)
        rank = rank_of(self.hot, seating.words)
        outer = np.zeros(len(self.hot), np.int64)
        outer[rank[rank >= 0]] = sent[rank >= 0]
        own = seating.totals(Totals(0), seating.tables)
        sums = [int((seating.customers == 1).sum()), int((seating.customers == 2).sum()),
                *strength_evidence(own.customers, own.tables, discount).tolist(), *outer.tolist()]
        return [(part, STATE, 0, packed(seating.tables.astype("u4"), seating.old_tables.astype("u4")), sums),
                *((to, SENT, part, packed(sent[at].astype("u4")), None) for to, at in self.dealt(seating))]

    def first(self, rows: pd.DataFrame) -> pd.DataFrame:
        part, seating = int(rows["part"].iloc[0]), FarSeating.begin(rows["head"])
        count = seating.by_word(seating.customers)
        return _frame([(part, FIXED, 0, seating.fixed(), None), *self.rows(part, seating),
                       *((to, FIXED, part, packed(seating.words[at], count[at].astype("u4")), None) for to, at in self.dealt(seating))])

    def replies(self, rows: pd.DataFrame, hot_count: np.ndarray, hot_tops: list[np.ndarray], samples: list[Totals]) -> tuple[FarSeating, np.ndarray, list[np.ndarray]]:
        """The seating, and its words' training occurrences (0 where the replies lack them) and parent probabilities in each sample."""
        seating = FarSeating.load(_of_kind(rows, FIXED)[0], _of_kind(rows, STATE)[0])
        rank = rank_of(self.hot, seating.words)
        met, count, tops = rank >= 0, np.zeros(len(rank), np.int64), [np.zeros(len(rank)) for _ in samples]
        count[met] = hot_count[rank[met]]
        for top, hot_top in zip(tops, hot_tops):
            top[met] = hot_top[rank[met]]
        sent = _of_kind(rows, SENT)
        for part, at in self.dealt(seating):
            *known, customers, tables = (x.astype(np.int64) for x in unpacked(sent[part]))
            if known:
                count[at] = known[0]
            for top, totals, (customers, tables) in zip(tops, samples, (known[1:], (customers, tables))[-len(samples):]):
                top[at] = totals.top(customers, tables)
        return seating, count, tops

    def sweep(self, hot_count: np.ndarray, hot_top: np.ndarray, totals: Totals, n: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            part = int(rows["part"].iloc[0])
            seating, _, (top,) = self.replies(rows, hot_count, [hot_top], [totals])
            return _frame(self.rows(part, seating.sweep(totals, top, np.random.default_rng([SEED, n, -1 - part, 1])), totals.discount))

        return run


def _outer(hashes: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Tables of the part's words in far restaurants."""
    asked, outer = _of_kind(rows, FIXED), np.zeros(len(hashes), np.int64)
    for other, blob in _of_kind(rows, SENT).items():
        h, count = unpacked(asked[other])
        outer[np.searchsorted(hashes, h[count > 0])] += unpacked(blob)[0][count > 0]
    return outer


def _near_rows(part: int, seating: Seating, rows: pd.DataFrame, scoring: bool = True) -> pd.DataFrame:
    """The state, and the reply to each far part: parent customers and tables; for scoring also occurrences, and those of the sweep before."""
    counts = [seating.count, seating.top_customers(True), seating.old_top_tables] * scoring + [seating.top_customers(), seating.top_tables]
    out = [(part, STATE, 0, seating.dump(), seating.sums().tolist())]
    for other, blob in _of_kind(rows, FIXED).items():
        h, _ = unpacked(blob)
        values = np.zeros((len(counts), len(h)), "u4")
        # A word without training occurrences behind far contexts may have some behind near ones.
        place = np.minimum(np.searchsorted(seating.hashes, h), max(len(seating.hashes) - 1, 0))
        met = seating.hashes[place] == h if len(seating.hashes) else np.zeros(len(h), bool)
        values[:, met] = np.stack(counts)[:, place[met]]
        out.append((other, SENT, part, packed(*values), None))
    return _frame(out)


def first_seating(rows: pd.DataFrame) -> pd.DataFrame:
    """Dishes of a part, every dish at one table."""
    hashes, contexts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in rows["state"][rows["kind"] == STATE]:
        h, n, ctx, trained = unpacked(blob)
        keep = trained > 0
        hashes.append(np.repeat(h, n)[keep])
        contexts.append(ctx[keep].astype(np.int64))
        counts.append(trained[keep].astype(np.int64))
    asked = [unpacked(b) for b in _of_kind(rows, FIXED).values()]
    h, ctx, c = (np.concatenate(x) for x in (hashes, contexts, counts))
    words = np.unique(np.concatenate([h, *(w[n > 0] for w, n in asked)]))
    key, dish = np.unique(np.searchsorted(words, h) * CONTEXTS + ctx, return_inverse=True)
    customers = np.bincount(dish, c, len(key)).astype(np.int64)
    count = np.bincount(key // CONTEXTS, customers, len(words)).astype(np.int64)
    for w, n in asked:
        count[np.searchsorted(words, w[n > 0])] += n[n > 0]
    seating = Seating.begin(words, key // CONTEXTS, key % CONTEXTS, customers, _outer(words, rows), count)
    return _near_rows(int(rows["part"].iloc[0]), seating, rows)


def near_sweep(totals: Totals, n: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part, seating = int(rows["part"].iloc[0]), Seating.load(_of_kind(rows, STATE)[0])
        return _near_rows(part, seating.sweep(totals, _outer(seating.hashes, rows), np.random.default_rng([SEED, n, part + 1])), rows, last)

    return run


@dataclass
class Model:
    """What scoring needs: totals of the averaged sweeps, the hot tables, and the parts' seating as tables."""

    tokens: int
    vocabulary: int
    hot: np.ndarray
    hot_customers: np.ndarray
    samples: list[Totals]
    hot_dishes: np.ndarray  # log10 probability by hot word and near context
    hot_tops: list[np.ndarray]
    states: DataFrame
    far: DataFrame  # the far parts' rows: fixed, state and replies
    far_step: FarStep
    far_parts: int
    docs: DataFrame


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """``stored``, after which Spark removes the shuffle files of the write: nothing else reads them."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return stored(df, purpose)
    finally:
        conf.set(name, before)


def fit(docs: DataFrame, sweeps: int = SWEEPS, hot_words: int = HOT, tokens_per_part: int = TOKENS_PER_PART) -> Model:
    counts = _kept(word_counts(docs), "words")
    tokens, vocabulary = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    top = counts.orderBy(F.col("n").desc(), "h").limit(min(hot_words, HOT)).collect()  # HOT rows at most
    discard(counts)
    hot = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    parts, far_parts = (max(4, -(-tokens * n // tokens_per_part)) for n in (1, FAR_PARTS))
    hot_count = np.array([r["n"] for r in top], np.int64)
    far_step = FarStep(hot, parts)

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        """A far part seated, a near part's or some blocks' hot dishes counted; the hot ones get part -1."""
        part = int(rows["part"].iloc[0])
        if part < -1:
            return far_step.first(rows)
        return _frame([(part, STATE, 0, merged_heads(rows["head"]), None) if part < parts else (-1, STATE, part, merged_hot(rows["head"]), None)])

    deal = lambda rows, run: _kept(rows.groupBy("part").applyInPandas(tidied(run), _STATE), "seating")
    far = deal(blocks(docs, hot, parts, far_parts).select("part", "head"), counted)
    fixed = far.filter(F.col("kind") == FIXED)
    dense = np.zeros((max(len(hot), 1), CONTEXTS), np.int64)
    for r in hot_counts(far).collect():  # HOT * CONTEXTS rows at most
        dense[r["key"] // CONTEXTS, r["key"] % CONTEXTS] = r["n"]
    word, context = np.nonzero(dense)
    near = deal(far.filter("part >= 0"), first_seating)

    def far_sums() -> np.ndarray:
        """Dishes with one and two customers, evidence of strengths, and tables of the hot words: added up by Spark, some HOT rows."""
        out = np.zeros(2 + len(GRID) + len(hot), np.int64)
        for r in far.filter("part < -1 and sums is not null").select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
            out[r["i"]] = r["n"]
        return out

    seen = far_sums()
    seating = Seating.begin(np.arange(len(hot), dtype=np.uint64), word, context, dense[word, context], seen[2 + len(GRID):], hot_count)
    samples: list[Totals] = []
    for n in range(sweeps + 1):
        sums = seating.sums()
        for r in near.filter(F.col("kind") == STATE).select("sums").collect():  # one row per part
            sums = sums + np.array(r["sums"], np.int64)
        sums[2 * CONTEXTS + 2: 2 * CONTEXTS + 4] += seen[:2]
        samples.append(totals_of(sums, vocabulary))
        near_evidence = strength_evidence(samples[-1].customers, samples[-1].tables, samples[-1].discount)
        law = (seen[2: 2 + len(GRID)] + near_evidence) / 1024
        law = np.exp(law - law.max())
        samples[-1].strength = float(np.random.default_rng([SEED, n, 2]).choice(GRID, p=law / law.sum()))
        if n == sweeps:
            break
        totals = samples[-1]
        hot_top = totals.top(seating.top_customers(), seating.top_tables)
        before = (far if n else None, near)
        far = deal(fixed.filter("part < -1").unionByName(far.filter((F.col("part") < -1) & (F.col("kind") == STATE))).unionByName(
            near.filter("part < -1")), far_step.sweep(hot_count, hot_top, totals, n))
        near = deal(near.filter("part >= 0").unionByName(fixed.filter("part >= 0")).unionByName(far.filter("part >= 0")), near_sweep(totals, n, n == sweeps - 1))
        for gone in before:  # recovery needs the last sweep only; the first far table holds what is fixed
            discard(gone)
        seen = far_sums()
        seating = seating.sweep(totals, seen[2 + len(GRID):], np.random.default_rng([SEED, n, 0]))
    samples = samples[-AVERAGED:]
    tops, dishes = seating.probabilities(samples)
    # Hot words: a dense table, with the probability of every context, met or not.
    table_p = np.zeros(dense.shape)
    for totals, top_p in zip(samples, tops):
        everywhere = top_p if len(hot) else np.full(1, totals.top(0, 0))
        table_p += (totals.new_table(np.arange(CONTEXTS), everywhere[:, None]) / (totals.strength + totals.customers)) / len(samples)
    table_p[word, context] = dishes
    held = fixed.unionByName(far.filter(F.col("kind") == STATE)).unionByName(near).filter("part < -1")
    return Model(tokens, vocabulary, hot, hot_count, samples, np.log10(table_p), tops,
                 near.filter("part >= 0").select("part", "state"), held, far_step, far_parts, docs)


def _by_document(doc: np.ndarray, n: np.ndarray, size: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(doc, np.repeat(v, n), size) for v in values]


def score(model: Model, doc_type: str) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    samples, hot_dishes, hot_customers, tokens = model.samples, model.hot_dishes, model.hot_customers, model.tokens
    far_step, hot_tops = model.far_step, model.hot_tops
    size_plus = tokens + model.vocabulary + 1

    def base(counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / size_plus)

    base_of_hot = base(hot_customers)

    def hot_sums(key: np.ndarray, n: np.ndarray, doc: np.ndarray, documents: int) -> bytes:
        word, context = key // CONTEXTS, key % CONTEXTS
        values = _by_document(doc, n, documents, (hot_customers[word] > 0).astype(float), base_of_hot[word], hot_dishes[word, context])
        return packed(np.arange(documents, dtype="u4"), *values)

    def cold_sums(rows: pa.Table, state: pd.DataFrame) -> list[bytes]:
        seating = Seating.load(state["state"].iloc[0]) if len(state) else Seating.begin(*(np.zeros(0, k) for k in (np.uint64, *[np.int64] * 5)))
        tops, dishes = seating.probabilities(samples)
        count = seating.count
        keys = seating.word.astype(np.int64) * CONTEXTS + seating.context
        sums = []
        for head, tail in zip(rows["head"], rows["tail"]):
            (h, per_word, context), (n, doc) = unpacked(head.as_py()), unpacked(tail.as_py())
            context = context.astype(np.int64)
            place = np.searchsorted(seating.hashes, h)
            inside = np.minimum(place, max(len(seating.hashes) - 1, 0))
            met = (seating.hashes[inside] == h) if len(seating.hashes) else np.zeros(len(h), bool)
            at, met = np.repeat(inside, per_word), np.repeat(met, per_word)
            p = np.zeros(len(context))
            for totals, top in zip(samples, tops):
                above = np.where(met, top[at], totals.top(0, 0)) if len(top) else np.full(len(at), totals.top(0, 0))
                p += totals.in_context(0, 0, context, above) / len(samples)
            if len(keys):
                dish = np.minimum(np.searchsorted(keys, at * CONTEXTS + context), len(keys) - 1)
                own = met & (keys[dish] == at * CONTEXTS + context)
                p = np.where(own, dishes[dish], p)
            c = np.where(met, count[at], 0) if len(count) else np.zeros(len(at))
            documents, doc = np.unique(doc, return_inverse=True)
            sums.append(packed(documents.astype("u4"), *_by_document(doc, n, len(documents), (c > 0).astype(float), base(c), np.log10(p))))
        return sums

    def far_sums(rows: pa.Table, state: pd.DataFrame) -> list[bytes]:
        seating, count, tops = far_step.replies(state, hot_customers, hot_tops, samples)
        p, sums = np.log10(seating.probabilities(samples, tops)), []
        keys = seating.context * len(seating.words) + seating.word
        for head, tail in zip(rows["head"], rows["tail"]):
            (contexts, per_context, words, index), (n, doc) = unpacked(head.as_py()), unpacked(tail.as_py())
            word = np.searchsorted(seating.words, words)[index]
            dish = np.searchsorted(keys, np.repeat(np.searchsorted(seating.contexts, contexts), per_context) * len(seating.words) + word)
            documents, doc = np.unique(doc, return_inverse=True)
            sums.append(packed(documents.astype("u4"), *_by_document(doc, n, len(documents), (count[word] > 0).astype(float), base(count[word]), p[dish])))
        return sums

    names = ["block", "sums", "doc_ids", "held", "lengths"]

    def part_sums(rows: pa.Table, state: pa.Table) -> pa.Table:
        """Sums of the documents in which a part's words occur, by block; those of the hot words are there already."""
        part = rows["part"][0].as_py() if rows.num_rows else None
        if part is None or part >= far_step.parts:
            sums = rows["tail"]
        else:
            sums = pa.array((cold_sums if part >= 0 else far_sums)(rows, state.to_pandas()), pa.binary())
        return pa.table([rows["block"], sums, rows["doc_ids"], rows["held"], rows["lengths"]], names)

    def per_document(rows: pa.Table) -> pa.Table:
        """Adds up a block's sums from all parts: at most two entries for each word of the block."""
        lists = rows.filter(pa.compute.is_valid(rows["lengths"])).combine_chunks()
        ids, held, lengths = (lists[c].chunk(0).flatten() for c in ("doc_ids", "held", "lengths"))
        totals = np.zeros((3, len(lengths)))
        for blob in rows["sums"].to_pylist():
            at, *values = unpacked(blob)
            totals[:, at] += np.stack(values)
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": lengths, "n_known": pa.array(totals[0].astype(np.int64)),
                         "train_tokens": pa.array(np.full(len(lengths), tokens, np.int64)), "base_score": pa.array(totals[1]), "score": pa.array(totals[2])})

    state = model.states.select("part", F.lit(STATE).alias("kind"), F.lit(0).alias("other"), "state").unionByName(
        model.far.select("part", "kind", "other", "state"))
    # All parts in one pass over the documents.
    found = blocks(model.docs, model.hot, far_step.parts, model.far_parts, hot_sums).groupBy("part").cogroup(state.groupBy("part")).applyInArrow(
        tidied(part_sums), f"block long, sums binary, doc_ids array<{doc_type}>, held array<boolean>, lengths array<long>")
    return found.groupBy("block").applyInArrow(
        per_document, f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, **settings) -> DataFrame:
    """Learns from all training documents and scores every document; see the module's text for odd rows."""
    return score(fit(docs, **settings), docs.schema["doc_id"].dataType.simpleString())
