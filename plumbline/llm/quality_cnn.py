"""Quality score of a document: a byte-level convolutional network in numpy.

Every byte has a learned vector. Learned filters of ``WIDTH`` bytes slide over the whole document in steps of
``STRIDE``; their responses are max-pooled in blocks of ``BLOCK`` bytes, two neighbouring blocks form a chunk
(so chunks overlap by half), and the largest and the mean response over all chunks are combined into one
probability. Long documents are read block by block; memory does not depend on their length in windows.

The network is trained on the driver from a sample of at most ``2 * PER_CLASS`` labelled texts of at most
``LONGEST`` bytes each, with a fixed number of steps. Scoring reads every text whole.

Inputs: null and empty texts are scored as a document of padding. Rows are scored one by one, so repeated and
null ids keep their rows. Without labels of both classes every score is the share of positive labels, 0.5
without any. Extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import encoded, labelled_sample, remainder, slices, tidy

MODULUS, LEFT_OUT = 4, 2
THRESHOLD = 0.7
PER_CLASS, LONGEST = 1500, 32_768
DIM, WIDTH, STRIDE, FILTERS, BLOCK = 6, 8, 2, 24, 256
STEPS, BATCH, RATE = 360, 32, 0.01
TILE = 128  # blocks multiplied at a time


class Network:
    """Parameters: byte vectors, filters, filter biases, output weights and bias."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {
            "E": draw.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "W": draw.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "u": draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def _layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts one after the other, each padded by at least a filter's width to whole blocks; and block offsets."""
        blocks = np.array([-(-(len(t) + WIDTH) // BLOCK) for t in texts], np.int64)
        edges = np.concatenate(([0], np.cumsum(blocks)))
        flat = np.zeros(edges[-1] * BLOCK + WIDTH, np.uint8)
        for t, at in zip(texts, edges[:-1] * BLOCK):
            flat[at: at + len(t)] = np.frombuffer(t, np.uint8)
        return flat, edges

    def _pooled(self, flat: np.ndarray, edges: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each block, and its window if asked for."""
        per, n = BLOCK // STRIDE, edges[-1]
        out = np.empty((n, FILTERS), np.float32)
        arg = np.empty((n, FILTERS), np.int64) if where else None
        last = np.zeros(n, bool)
        last[edges[1:] - 1] = True
        for lo in range(0, n, TILE):
            hi = min(lo + TILE, n)
            x = np.ascontiguousarray(self.p["E"][flat[lo * BLOCK: hi * BLOCK + WIDTH]])
            windows = np.lib.stride_tricks.as_strided(
                x, ((hi - lo) * per, WIDTH * DIM), (STRIDE * DIM * 4, 4), writeable=False)
            z = (np.ascontiguousarray(windows) @ self.p["W"]).reshape(hi - lo, per, FILTERS)
            z[last[lo:hi], per - WIDTH // STRIDE:, :] = -np.inf  # windows that would reach into the next text
            if where:
                arg[lo:hi] = z.argmax(axis=1)
            out[lo:hi] = z.max(axis=1)
        return np.maximum(out + self.p["b"], 0), arg

    def _features(self, pooled: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: largest and mean over the chunks; a chunk takes the larger of two neighbouring blocks."""
        n = len(pooled)
        following = np.minimum(np.arange(n) + 1, np.repeat(edges[1:] - 1, np.diff(edges)))
        second = pooled[following] > pooled
        chunk = np.where(second, pooled[following], pooled)
        top = np.maximum.reduceat(chunk, edges[:-1], axis=0)
        mean = np.add.reduceat(chunk, edges[:-1], axis=0) / np.diff(edges)[:, None]
        return np.concatenate([top, mean], axis=1), chunk, np.where(second, following[:, None], np.arange(n)[:, None])

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        flat, edges = self._layout(texts)
        pooled, _ = self._pooled(flat, edges, False)
        z = self._features(pooled, edges)[0].astype(np.float64) @ self.p["u"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        p, (flat, edges) = self.p, self._layout(texts)
        pooled, arg = self._pooled(flat, edges, True)
        features, chunk, source = self._features(pooled, edges)
        prob = 1 / (1 + np.exp(-np.clip(features @ p["u"] + p["c"][0], -30, 30)))
        loss = -np.mean(np.log(np.where(labels == 1, prob, 1 - prob) + 1e-9))
        dz = ((prob - labels) / len(texts)).astype(np.float32)
        g = {"u": features.T @ dz, "c": dz.sum(keepdims=True)}
        counts = np.diff(edges)
        dmean = np.repeat((dz / counts)[:, None] * p["u"][FILTERS:], counts, axis=0)
        # The largest chunk of each document and filter gets the rest.
        f = np.arange(FILTERS)
        top = np.stack([chunk[a:b].argmax(axis=0) + a for a, b in zip(edges[:-1], edges[1:])])
        dmean[top, f[None, :]] += dz[:, None] * p["u"][:FILTERS]
        dblock = np.zeros_like(pooled)
        np.add.at(dblock, (source, np.broadcast_to(f, source.shape)), dmean)
        dblock[pooled <= 0] = 0
        g["b"] = dblock.sum(axis=0)
        block, filt = np.nonzero(dblock)
        at = block * BLOCK + arg[block, filt] * STRIDE
        grad = dblock[block, filt]
        seen = flat[at[:, None] + np.arange(WIDTH)]
        g["W"] = np.zeros_like(p["W"])
        vectors = p["E"][seen].reshape(len(at), WIDTH * DIM) * grad[:, None]
        for k in range(FILTERS):
            g["W"][:, k] = vectors[filt == k].sum(axis=0)
        back = (p["W"].T[filt] * grad[:, None]).reshape(-1, DIM)
        g["E"] = np.stack([np.bincount(seen.ravel(), back[:, d], 256) for d in range(DIM)], axis=1).astype(np.float32)
        return g, float(loss)

    def fit(self, sample: list[tuple[str, int]], steps: int = STEPS, seed: int = 11, share: float | None = None) -> Network:
        """Adam over mini-batches that hold both classes in equal parts; then the odds of ``share``, the part of label 1."""
        texts, labels = [encoded(t) for t, _ in sample], np.array([y for _, y in sample])
        ones, zeros = np.nonzero(labels == 1)[0], np.nonzero(labels == 0)[0]
        if not len(ones) or not len(zeros):
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([draw.choice(ones, BATCH // 2), draw.choice(zeros, BATCH // 2)])
            g, _ = self.gradients([texts[i] for i in pick], labels[pick])
            rate = RATE * (1 if step < 0.6 * steps else 0.3)
            for k, d in g.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32)
        if share is not None and 0 < share < 1:
            self.p["c"] += np.float32(np.log(share / (1 - share)))
        return self


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST, steps: int = STEPS) -> Network:
    """Fitted on the bounded sample; the share of good documents comes from all labels that may be learnt from."""
    known = labels.filter((remainder(F.col("doc_id"), MODULUS) != LEFT_OUT) & F.col("quality").isin(0, 1))
    share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return Network().fit(labelled_sample(docs, labels, "quality", MODULUS, LEFT_OUT, per_class, longest), steps, share=share)


def _scores(network: Network, texts: pa.Array) -> np.ndarray:
    return network.probabilities([encoded(t) for t in texts.to_pylist()])


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                s = _scores(network, cut.column(2))
                yield pa.record_batch([cut.column(0), cut.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                      names=["doc_id", "held_out", "score", "predicted"])

    held_out = remainder(F.col("doc_id"), MODULUS) == LEFT_OUT
    return docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, network: Network) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; decided where the rows lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                yield cut.filter(pa.array(_scores(network, cut.column(cut.schema.get_field_index("text"))) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
