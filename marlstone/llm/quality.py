"""Operator 8: quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover the whole of it. A byte enters as one of two
symbols, by whether it lies in a run of four bytes that also stood at most ``LAGS`` bytes before. Filters over ``WIDTH`` bytes slide
through each chunk (a filter is a table of one weight per position and byte, so a convolution is a sum of gathers), and
each filter's output is rectified and max-pooled over the chunk. The mean and the maximum of the chunks' pooled values
go through a logistic layer to one probability.

The network is fitted on the driver on whole texts of at most ``FIT_ROWS`` labelled documents; scoring reads every byte.
Labels of held-out ids never enter. Without both classes among the labels the score is the smoothed share of label 1.

The input is wider than plain bytes: that a byte repeats what stood shortly before is computed, not learned, since eight
bytes are too short to see it.

Null and empty texts are one chunk of padding; repeated rows get equal scores; a null doc_id is not held out; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import slices
from marlstone.llm.labelled import remainder, sample

CHUNK, STEP = 512, 448
WIDTH, STRIDE, FILTERS = 8, 4, 16
REPEAT = 256  # added to a byte that repeats
PAD = 2 * REPEAT
LAGS = 24
FIT_ROWS = 2_000
MODULUS, HELD_OUT = 3, 1
BATCH = 256  # chunks convolved at a time


def repeats(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a run of four that also stood a few bytes before."""
    found = np.zeros(len(raw), dtype=bool)
    for lag in range(2, min(LAGS, len(raw) - 4) + 1):
        same = raw[lag:] == raw[:-lag]
        found[lag : len(raw) - 3] |= same[:-3] & same[1:-2] & same[2:-1] & same[3:]
    return found


def chunked(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) of byte values, padded at the end; the chunks overlap and cover all of data."""
    n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    flat = np.full((n - 1) * STEP + CHUNK, PAD, dtype=np.int16)
    raw = np.frombuffer(data, dtype=np.uint8)
    flat[: len(data)] = raw
    flat[: len(data)][repeats(raw)] += REPEAT
    return flat[np.arange(n)[:, None] * STEP + np.arange(CHUNK)]


class ByteNet:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.conv = (rng.standard_normal((WIDTH, PAD + 1, FILTERS)) * 0.15).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.out_bias = np.float32(0)

    def pool(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters of each chunk, and where each maximum is."""
        n = (CHUNK - WIDTH) // STRIDE + 1
        best = np.empty((len(chunks), FILTERS), dtype=np.float32)
        at = np.empty((len(chunks), FILTERS), dtype=np.int64)
        for i in range(0, len(chunks), BATCH):
            part = chunks[i : i + BATCH]
            total = np.repeat(self.bias[None, None, :], 1, 0)
            for o in range(WIDTH):
                total = total + self.conv[o].take(part[:, o : o + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
            at[i : i + BATCH] = total.argmax(axis=1)
            best[i : i + BATCH] = total.max(axis=1)
        return np.maximum(best, 0), at

    def combine(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(documents, 2 * FILTERS): mean and maximum over the chunks of each document."""
        counts = np.diff(np.append(starts, len(pooled)))[:, None]
        return np.concatenate([np.add.reduceat(pooled, starts, axis=0) / counts, np.maximum.reduceat(pooled, starts, axis=0)], axis=1)

    def probability(self, texts: list[bytes]) -> np.ndarray:
        parts = [chunked(t) for t in texts]
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        features = self.combine(self.pool(np.concatenate(parts))[0], starts)
        return 1 / (1 + np.exp(-np.clip(features @ self.out + self.out_bias, -30, 30).astype(np.float64)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        docs = [chunked(t) for t in texts]
        params = [self.conv, self.bias, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        balance = np.sqrt(balance)  # between the natural and an even share
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), 64):
                rows = order[i : i + 64]
                parts = [docs[r] for r in rows]
                sizes = np.array([len(p) for p in parts])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                chunks = np.concatenate(parts)
                pooled, at = self.pool(chunks)
                features = self.combine(pooled, starts)
                p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.out_bias, -30, 30)))
                error = ((p - labels[rows]) * balance[rows] / len(rows)).astype(np.float32)
                g_out = features.T @ error + 1e-4 * self.out
                g_feat = error[:, None] * self.out[None, :]
                owner = np.repeat(np.arange(len(rows)), sizes)
                g_pool = g_feat[owner, :FILTERS] / sizes[owner][:, None]
                is_max = pooled == features[owner, FILTERS:]
                g_pool = (g_pool + g_feat[owner, FILTERS:] * is_max) * (pooled > 0)
                g_conv = np.zeros_like(self.conv)
                filters = np.arange(FILTERS)[None, :]
                for o in range(WIDTH):
                    byte = np.take_along_axis(chunks, at * STRIDE + o, axis=1)
                    np.add.at(g_conv[o], (byte, filters), g_pool)
                step += 1
                for p_, g, m, v in zip(params, [g_conv, g_pool.sum(axis=0), g_out], first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                self.out_bias -= np.float32(rate * error.sum())


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> ByteNet | float:
    """A fitted network; a constant where the labels have fewer than two classes."""
    rows = sample(docs, labels, "quality", MODULUS, HELD_OUT, limit).orderBy("doc_id", "text").collect()
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    net = ByteNet()
    net.fit([r["text"].encode() for r in rows], y)
    return net


def score(docs: DataFrame, model: ByteNet | float) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            values = np.full(len(texts), net) if isinstance(net, float) else np.concatenate([net.probability(texts[i : i + 32]) for i in range(0, len(texts), 32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, limit))
