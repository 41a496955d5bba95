"""Language of a text by rank-order profiles of its character n-grams.

Texts are lower-cased and cut into words of letters; a word stands between two boundaries. A profile is the list of the
``PROFILE`` most frequent n-grams of one to three characters, ranked by count and, where counts tie, by the n-gram. The
profile of a language counts all its training documents, each whole. A document is held against every language by the
out-of-place distance: the difference of the ranks of each of its own most frequent n-grams, or ``PROFILE`` for one the
language lacks. The nearest language wins, the smaller name where two are as near. The score is one minus the winner's
distance over the largest possible one.

Odd rows: a null text, or one without a letter, is ``und`` with score 0; so is every text when no language was learned.
A row without an id is held out, since the crc32 of the empty text is 0. Rows that share an id or repeat count each.
Long texts are counted in blocks. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import remainder, slices
from plumbline.operators.ranking import top_n

MODULUS, LEFT_OUT = 5, 0
PROFILE = 300
UNKNOWN = "und"
#: Bytes of text, and characters of one text, that are counted at a time; n-grams whose counts a task holds.
_SLICE, _BLOCK, _HELD = 1 << 20, 1 << 20, 1 << 18
#: Bits of a code point, three of which fit into a long; the boundary is no code point.
_BITS, _EDGE = 21, 0x110000
#: The profiles are broadcast, some 5 KB for each language; more languages raise.
MOST_LANGUAGES = 4096


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def word_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text's letters; one boundary for each run of anything else and for both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate(([_EDGE], np.where(letters()[codes], codes, _EDGE), [_EDGE])).astype(np.int64)
    inner = codes != _EDGE
    return codes[np.concatenate(([True], inner[1:] | inner[:-1]))]


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the n-grams of one, two and three characters, block by block.

    A boundary begins or ends an n-gram, but neither stands alone nor between two letters.
    """
    for start in range(0, len(codes), _BLOCK):
        block = codes[start: start + _BLOCK + 2]
        own = block[:_BLOCK]
        two = (block[:-1] << _BITS | block[1:])[:_BLOCK]
        three = (block[:-2] << 2 * _BITS | block[1:-1] << _BITS | block[2:])[:_BLOCK]
        yield np.concatenate((own[own != _EDGE], two, three[block[1:-1][:_BLOCK] != _EDGE]))


def counted(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, and the sums of their counts."""
    parts = list(parts)
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, where, np.concatenate([n for _, n in parts]))
    return keys, totals


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    return counted(np.unique(part, return_counts=True) for part in grams(word_codes(text)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent keys; equal counts go by key."""
    return keys[np.lexsort((keys, -counts))[:size]]


# ---- profiles -----------------------------------------------------------------------------

def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over whole texts with a language; summed in the tasks before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = counted(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts: dict[str, list[str]] = defaultdict(list)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    texts[lang].append(text or "")
                for lang, of in texts.items():
                    held[lang].append(text_counts("\n".join(of)))
                    size += len(held[lang][-1][0])
                if size > _HELD:
                    yield from emptied()
                    size = 0
        yield from emptied()

    known = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    return known.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Profiles:
    """Ranks of the profiles' n-grams: for each key a run of (language, rank) pairs."""

    def __init__(self, languages: list[str], lang: np.ndarray, key: np.ndarray, rank: np.ndarray, size: int = PROFILE):
        self.languages, self.size = languages, size
        order = np.argsort(key, kind="stable")
        self.lang, self.rank = lang[order], rank[order]
        self.keys, self.starts = np.unique(key[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))

    def distances(self, doc: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked keys to every language."""
        at = np.searchsorted(self.keys, doc)
        at[at == len(self.keys)] = 0
        met = np.flatnonzero(self.keys[at] == doc)
        starts, runs = self.starts[at[met]], (self.ends - self.starts)[at[met]]
        pairs = np.repeat(starts - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        nearer = self.size - np.abs(self.rank[pairs] - np.repeat(met, runs))
        return self.size * len(doc) - np.bincount(self.lang[pairs], weights=nearer, minlength=len(self.languages)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        doc = ranked(*text_counts(text or ""), self.size)
        if not len(doc) or not self.languages:
            return UNKNOWN, 0.0
        distance = self.distances(doc)
        best = int(np.argmin(distance))  # languages are in ascending order
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(doc))


def train(docs: DataFrame, modulus: int = MODULUS, left_out: int = LEFT_OUT, size: int = PROFILE) -> Profiles:
    """Profiles of all languages, from the documents that are not held out."""
    counts = ngram_counts(docs.filter(remainder(F.col("doc_id"), modulus) != left_out))
    top = top_n(counts, ["lang"], [F.col("n").desc(), F.col("key")], size).select("lang", "key", (F.col("rn") - 1).alias("rank"))
    rows = top.limit(MOST_LANGUAGES * size + 1).collect()
    languages = sorted({r["lang"] for r in rows})
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their profiles would not fit into a broadcast")
    number = {lang: i for i, lang in enumerate(languages)}
    columns = [np.array([f(r) for r in rows], np.int64) for f in (lambda r: number[r["lang"]], lambda r: r["key"], lambda r: r["rank"])]
    return Profiles(languages, *columns, size)


def identify(docs: DataFrame, profiles: Profiles, modulus: int = MODULUS, left_out: int = LEFT_OUT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = [known.value.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", "text", (remainder(F.col("doc_id"), modulus) == left_out).alias("held_out"))
    return held.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
