"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A document is toxic if at least one sentence is: P(doc) = 1 - (1 - leak) * prod(1 - p(sentence)), a noisy-or.
p(sentence) is logistic in the words of the sentence and their first letters; those take part that the training
labels associate with toxic documents, and a sentence without any of them contributes nothing, so that length
alone never makes a document toxic. The weights are trained on document labels only, by the gradient of the
document likelihood; sentences are then located by their own probability.

Trained on the driver from at most ``2 * PER_CLASS`` labelled texts of at most ``LONGEST`` bytes each. Scoring
reads every text whole. Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters; sentences
end at ``.``, ``!``, ``?`` and line feeds.

Inputs: null and empty texts score the leak. Rows are scored one by one, so repeated and null ids keep their
rows. Without labels of both classes every score is the share of toxic labels, 0 without any. Extra columns are
ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import ALNUM_BYTES, SENTENCE_BYTES, encoded, labelled_sample, remainder, slices, tidy

MODULUS, LEFT_OUT = 3, 1
THRESHOLD = 0.7
PER_CLASS, LONGEST = 2000, 32_768
#: A word takes part if its documents are toxic this much more often than the rest, in log odds and in deviations.
MIN_LIFT, MIN_Z, MIN_DOCS = 1.5, 3.5, 3
STEPS, RATE, SHRINK = 300, 0.1, 0.01
LOCATED = 0.5
PREFIXES = (4, 5, 6)
#: Cells of the table that finds rare features.
BUCKETS = 1 << 22


def features_of(word: bytes) -> list[bytes]:
    """The word, and its first bytes as features of their own, so that inflected forms share evidence."""
    return [word, *(b"^" + word[:n] for n in PREFIXES if len(word) > n)]


def sentences_of(text: str | None) -> list[list[bytes]]:
    return [s.split() for s in encoded(text).translate(SENTENCE_BYTES).split(b"\n")]


class SentenceModel:
    def __init__(self) -> None:
        self.weights: dict[bytes, float] = {}
        self.bias, self.leak = -2.0, 0.0

    def fit(self, sample: list[tuple[str, int]]) -> SentenceModel:
        n1 = sum(y for _, y in sample)
        n0 = len(sample) - n1
        if not n1 or not n0:
            self.leak = float(n1 > 0)
            return self
        words = self._vocabulary(sample, n1, n0)
        index = {w: i for i, w in enumerate(words)}
        # Instances: sentences with a word that takes part, as (sentence, word) pairs; and the document of each.
        pairs, owner = [], []
        for d, (text, _) in enumerate(sample):
            for s in sentences_of(text):
                ids = {index[f] for w in set(s) for f in features_of(w) if f in index}
                if ids:
                    pairs += [(len(owner), i) for i in ids]
                    owner.append(d)
        y = np.array([y for _, y in sample], float)
        w, b, leak = np.full(len(words), 3.0), self.bias, -3.0
        pairs_s, pairs_w = (np.array(c, np.int64) for c in (zip(*pairs) if pairs else ((), ())))
        owner = np.array(owner, np.int64)
        params, m, v = np.concatenate([w, [b, leak]]), 0.0, 0.0
        for step in range(1, STEPS + 1):
            w, b, leak = params[:-2], params[-2], params[-1]
            z = np.bincount(pairs_s, w[pairs_w], len(owner)) + b
            none = np.bincount(owner, np.logaddexp(0, z), len(y)) + np.logaddexp(0, leak)  # -log P(clean)
            # d log-likelihood / d none: toxic exp(-none) / (1 - exp(-none)), clean -1
            outer = np.where(y == 1, 1 / np.expm1(np.clip(none, 1e-9, 500)), -1.0)
            dz = outer[owner] / (1 + np.exp(-z)) if len(owner) else np.zeros(0)
            grad = np.concatenate([np.bincount(pairs_w, dz[pairs_s], len(words)) - SHRINK * w,
                                   [dz.sum() - SHRINK * b, outer.sum() / (1 + math.exp(-leak))]])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            params = params + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            params[:-2] = np.maximum(params[:-2], 0)  # a word can only speak for toxicity
        self.weights = dict(zip(words, params[:-2].tolist()))
        self.bias, self.leak = float(params[-2]), float(1 / (1 + math.exp(-params[-1])))
        return self

    def _vocabulary(self, sample: list[tuple[str, int]], n1: int, n0: int) -> list[bytes]:
        """Features of toxic documents that are rarer elsewhere. A table of hashed counts first leaves out those of too few
        documents, so only features that can take part are counted by name."""
        def of(text: str) -> set[bytes]:
            return {f for w in set(encoded(text).translate(ALNUM_BYTES).split()) for f in features_of(w)}

        rough = np.zeros(BUCKETS, np.int32)
        for text, y in sample:
            if y:
                rough[np.unique(np.fromiter((zlib.crc32(f) % BUCKETS for f in of(text)), np.int64))] += 1
        seen = {0: Counter(), 1: Counter()}
        for text, y in sample:
            seen[y].update(f for f in of(text) if rough[zlib.crc32(f) % BUCKETS] >= MIN_DOCS)
        return sorted(f for f, k1 in seen[1].items() if k1 >= MIN_DOCS and self._associated(k1, seen[0][f], n1, n0))

    @staticmethod
    def _associated(k1: int, k0: int, n1: int, n0: int) -> bool:
        lift = math.log((k1 + 0.5) / (n1 - k1 + 0.5)) - math.log((k0 + 0.5) / (n0 - k0 + 0.5))
        spread = math.sqrt(1 / (k1 + 0.5) + 1 / (n1 - k1 + 0.5) + 1 / (k0 + 0.5) + 1 / (n0 - k0 + 0.5))
        return lift >= MIN_LIFT and (lift / spread >= MIN_Z or k0 == 0 and k1 >= 2 * MIN_DOCS)

    def evidence(self, texts: list[bytes]) -> dict[bytes, float]:
        """Summed weight of each distinct word of the texts that has any."""
        get, found = self.weights.get, {}
        for w in set().union(*(t.split() for t in texts)):
            z = sum(get(f, 0.0) for f in features_of(w))
            if z > 0:
                found[w] = z
        return found

    def located(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """Per text: (sentence number, probability) of the sentences that have a word of the model."""
        out, data = [], [encoded(t).translate(SENTENCE_BYTES) for t in texts]
        weights = self.evidence(data)
        for text in data:
            found: list[tuple[int, float]] = []
            if not weights.keys().isdisjoint(text.split()):
                for i, s in enumerate(text.split(b"\n")):
                    known = [weights[w] for w in set(s.split()) if w in weights]
                    if known:
                        found.append((i, 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(known)))))))
            out.append(found)
        return out

    def combine(self, found: list[tuple[int, float]]) -> float:
        return 1 - (1 - self.leak) * math.prod(1 - p for _, p in found)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> SentenceModel:
    return SentenceModel().fit(labelled_sample(docs, labels, "toxic", MODULUS, LEFT_OUT, per_class, longest))


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending sentence numbers from 0, worst sentence) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                found = model.located(cut.column(2).to_pylist())
                s = np.array([model.combine(f) for f in found])
                yield pa.record_batch([
                    cut.column(0), cut.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)),
                    pa.array([[i for i, p in f if p >= LOCATED] for f in found], pa.list_(pa.int32())),
                    pa.array([max(f, key=lambda x: x[1])[0] if f else None for f in found], pa.int32())],
                    names=["doc_id", "held_out", "score", "predicted", "offending", "worst"])

    held_out = remainder(F.col("doc_id"), MODULUS) == LEFT_OUT
    return docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, offending array<int>, worst int")


def keep_clean(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """The rows, with all their columns, that score below the threshold; decided where the rows lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                texts = cut.column(cut.schema.get_field_index("text")).to_pylist()
                yield cut.filter(pa.array([model.combine(f) < THRESHOLD for f in model.located(texts)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
