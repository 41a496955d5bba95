"""Quality rules from tokeniser fertility.

Public vocabularies are used as measuring rods: text that a vocabulary was not made for falls into many short
tokens. Per document: characters per token of a byte-level BPE, the share of byte-fallback tokens of a piece
vocabulary, and the entropy of the token distribution. Each measure has a band per language (or, where a
document names none, per script), placed around the quantiles of all documents of that group; a document
outside a band is rejected. The byte-level tokens are those of the whole text as it stands; the piece vocabulary, which
knows white space only as the beginning of a word, measures the words.

The base rules come first: fewer than ``MIN_WORDS`` words, or more than 30 % of the words in 8-word windows
that occur again in the document, reject it.

Inputs: a null text has no words. Rows are judged one by one, also when ids repeat or are null. The ends of a language's
band lean on those of the document's script by ``LEAN`` to the language's number of documents, so that a small language
is judged mostly by its script, and no number is a step. A script's own ends need no such help: those of a few documents
enclose them all. Extra columns are ignored; a table without ``lang`` is grouped by script. An empty table gives an empty
result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import encoded, slices, stored
from plumbline.llm.encoding import WordMemory, default_path, encoder

MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_token", "fallback_share", "entropy")
#: A band reaches from the lower to the upper quantile and this many times the distance to the median beyond.
LOWER, UPPER, REACH = 0.05, 0.95, 2.0
#: Documents of a language that weigh as much as its script.
LEAN = 50
SCRIPTS = (("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
           ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7AF), ("cjk", 0x3040, 0x9FFF))
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def script_of(text: str) -> str:
    """The script of most letters outside ASCII, if they are at least a fifth of the characters; latin otherwise."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = {name: int(((points >= lo) & (points <= hi)).sum()) for name, lo, hi in SCRIPTS}
    name = max(counts, key=counts.get)
    return name if counts[name] * 5 >= max(1, len(points)) else "latin"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice; windows are equal only if all their words are."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (ids[i: n + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
    if len(np.unique(key)) == n:
        return 0
    # Some keys are equal: rank the windows exactly, by doubling pairs of ranks.
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < window:
        pair = rank[:-width] * (rank.max() + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.nonzero(again)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


class Pieces:
    """The piece vocabulary: how many pieces a word has, and how many of them are single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.memory = WordMemory(self._learn)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(words, num_threads=1)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        single = np.concatenate(([0], np.cumsum(self.is_byte[np.fromiter((i for ids in found for i in ids), np.int64, int(lengths.sum()))])))
        ends = np.cumsum(lengths)
        return np.stack((lengths, single[ends] - single[ends - lengths]), 1).astype("<u4").ravel(), np.full(len(found), 2, np.int64)

    def counts(self, words: pa.Array) -> np.ndarray:
        """(pieces, single bytes) of distinct words."""
        return self.memory.numbers(self.memory.find(words)).reshape(-1, 2).astype(np.int64)


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    ordered = np.sort(ids)
    edge = np.concatenate((np.nonzero(np.diff(ordered))[0] + 1, [len(ordered)]))
    p = np.diff(np.concatenate(([0], edge))) / len(ordered)
    return float(-(p * np.log2(p)).sum())


def measure(texts: list[str | None], bpe: str, pieces: str) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, three measures, script) of each text."""
    data = [encoded(t) for t in texts]
    split = [d.split() for d in data]
    tokens, token_ends = encoder(bpe).encoded([t or "" for t in texts])
    coded = pa.array([w for words in split for w in words], pa.binary()).cast(pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pieces_of(pieces).counts(coded.dictionary)[codes]
    out, start, first = [], 0, 0
    for text, raw, words, end in zip(texts, data, split, token_ends.tolist()):
        last = first + len(words)
        points = np.frombuffer(raw, np.uint8)
        chars = len(points) - int(((points & 0xC0) == 0x80).sum() + (points == 0x20).sum() + ((points >= 9) & (points <= 13)).sum())
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        n_pieces, n_bytes = counts[first:last].sum(axis=0).tolist()
        out.append((len(words), chars, len(raw.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(codes[first:last]),
                    chars / (end - start) if end > start else 0.0, n_bytes / n_pieces if n_pieces else 0.0, _entropy(tokens[start:end]),
                    script_of(text or "") if raw and not raw.isascii() else "latin"))
        start, first = end, last
    return out


_SCHEMA = ("doc_id {id}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "chars_per_token double, fallback_share double, entropy double, script string")


def measured(docs: DataFrame, bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    bpe, pieces = bpe or default_path(), pieces or default_path("piece_bpe_32k.model")
    schema = _SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]
    lang: Column = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                columns = list(zip(*measure(cut.column(2).to_pylist(), bpe, pieces)))
                kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.string()]
                yield pa.record_batch([cut.column(0), cut.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return docs.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def bands(rows: DataFrame) -> DataFrame:
    """Per language and script the number of documents the base rules keep, and the lower and upper end of each measure."""
    quantiles = [F.percentile_approx(m, F.array(F.lit(LOWER), F.lit(0.5), F.lit(UPPER)), 10_000).alias(m) for m in MEASURES]
    groups = rows.select(F.explode(F.array_compact(F.array("lang_group", "script_group"))).alias("group"), *MEASURES)
    found = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *quantiles)
    ends = []
    for m in MEASURES:
        low, mid, high = (F.col(m)[i] for i in range(3))
        ends += [(low - REACH * (mid - low)).alias(f"{m}_low"), (high + REACH * (high - mid)).alias(f"{m}_high")]
    return found.select("group", "n", *ends)


def apply_rules(docs: DataFrame, bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    """Per document: the base columns, base_failed, kept, the measures and the reasons; see the module's text."""
    rows = measured(docs, bpe, pieces)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed).withColumn("lang_group", F.concat(F.lit("lang:"), "lang"))
                  .withColumn("script_group", F.concat(F.lit("script:"), "script")), "fertility")
    ends = stored(bands(rows.filter(~F.col("base_failed"))), "bands")
    # One row for each language and script, joined by name.
    joined, names = rows, [c for c in ends.columns if c != "group"]
    for kind in ("lang", "script"):
        own = ends.filter(F.startswith("group", F.lit(f"{kind}:"))).select(F.col("group").alias(f"{kind}_group"), *[F.col(c).alias(f"{kind}_{c}") for c in names])
        joined = joined.join(own, f"{kind}_group", "left")
    weight = F.coalesce("lang_n", F.lit(0)) / (F.coalesce("lang_n", F.lit(0)) + LEAN)
    reasons = []
    for m in MEASURES:
        low, high = (weight * F.coalesce(f"lang_{m}_{e}", F.lit(0.0)) + (1 - weight) * F.col(f"script_{m}_{e}") for e in ("low", "high"))
        reasons.append(F.when((F.col(m) < low) | (F.col(m) > high), F.lit(m)))
    reason = F.array_compact(F.array(*reasons))
    return joined.withColumn("reasons", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(reason)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), *MEASURES, F.array_join("reasons", ",").alias("reasons"))
