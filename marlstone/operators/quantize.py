"""Quantised vectors: a seeded rotation, 3 bits per coordinate, and signs of projections of the residual.

score = <decoded, q> + |residual| * (sqrt(pi / 2) / m) * sum_j sign_j * <g_j, q>, an unbiased estimate of the inner
product. Codes are bytes: norm, residual norm (float32 each), 3-bit levels, sign bits. A code of another length is
corrupt and scores nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import vector

BITS = 3
SEED = 42
#: Optimal levels of a standard normal value in 3 bits (Max 1960); symmetric.
LEVELS = np.array([-2.152, -1.344, -0.756, -0.2451, 0.2451, 0.756, 1.344, 2.152])


class Quantizer:
    def __init__(self, dim: int, seed: int = SEED):
        self.dim, self.n_signs = dim, max(2 * dim, 32)
        rng = np.random.default_rng(seed)
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        self.projections = rng.standard_normal((self.n_signs, dim))
        self.edges = (LEVELS[1:] + LEVELS[:-1]) / 2
        self.code_bytes = 8 + -(-dim * BITS // 8) + -(-self.n_signs // 8)

    def encode(self, rows: np.ndarray) -> list[bytes]:
        rotated = rows.astype(np.float64) @ self.rotation.T
        length = np.linalg.norm(rotated, axis=1)
        scaled = rotated / np.where(length > 0, length, 1)[:, None] * np.sqrt(self.dim)
        level = np.searchsorted(self.edges, scaled)
        residual = rotated - self._decoded(level, length)
        signs = residual @ self.projections.T > 0
        bits = ((level[:, :, None] >> np.arange(BITS)) & 1).reshape(len(rows), -1)
        packed, marks = np.packbits(bits.astype(np.uint8), axis=1), np.packbits(signs, axis=1)
        return [
            struct.pack("<ff", n, r) + p.tobytes() + s.tobytes()
            for n, r, p, s in zip(length, np.linalg.norm(residual, axis=1), packed, marks, strict=True)
        ]

    def _decoded(self, level: np.ndarray, length: np.ndarray) -> np.ndarray:
        return LEVELS[level] / np.sqrt(self.dim) * length[:, None]

    def score(self, codes: list[bytes | None], query: np.ndarray) -> np.ndarray:
        return self.score_all(codes, np.asarray(query, dtype=np.float64)[None, :])[0]

    def score_all(self, codes: list[bytes | None], queries: np.ndarray) -> np.ndarray:
        """(queries, codes) of estimated inner products; 0 for missing or corrupt codes."""
        return self.asked(queries) @ self.parts(codes)[0].T

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """Queries as vectors whose inner products with parts() are the estimates."""
        q = np.asarray(queries, dtype=np.float64) @ self.rotation.T
        return np.concatenate([q, q @ self.projections.T], axis=1)

    def parts(self, codes: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, dim + n_signs): decoded coordinates and weighted signs; and the lengths. Zeros for missing or corrupt codes."""
        out, length = np.zeros((len(codes), self.dim + self.n_signs)), np.zeros(len(codes))
        good = [i for i, c in enumerate(codes) if c is not None and len(c) == self.code_bytes]
        if not good:
            return out, length
        raw = np.frombuffer(b"".join(codes[i] for i in good), dtype=np.uint8).reshape(len(good), -1)
        head = raw[:, :8].copy().view("<f4").astype(np.float64)
        split = 8 + -(-self.dim * BITS // 8)
        bits = np.unpackbits(raw[:, 8:split], axis=1)[:, : self.dim * BITS].reshape(len(good), self.dim, BITS)
        level = (bits << np.arange(BITS)).sum(axis=2)
        signs = np.unpackbits(raw[:, split:], axis=1)[:, : self.n_signs] * 2.0 - 1
        length[good] = head[:, 0]
        out[good, : self.dim] = self._decoded(level, head[:, 0])
        out[good, self.dim :] = signs * (head[:, 1] * np.sqrt(np.pi / 2) / self.n_signs)[:, None]
        return out, length


def encode(table: DataFrame, dim: int, embedding: str = "embedding", out: str = "turbo_code") -> DataFrame:
    """Adds the code of each vector; null for vectors of another width."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        q = Quantizer(dim)
        for s in parts:
            ok = [v is not None and len(v) == dim for v in s]
            codes = iter(q.encode(np.stack([v for v, k in zip(s, ok, strict=True) if k])) if any(ok) else [])
            yield pd.Series([next(codes) if k else None for k in ok], dtype=object)

    return table.withColumn(out, run(F.col(embedding)))


def scan(table: DataFrame, query: list[float], k: int, id_column: str = "vec_id", code: str = "turbo_code", batch: int = 4096) -> DataFrame:
    """(id, score): the k best by estimated inner product; each task sends on k rows."""
    q = np.array(query, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer = Quantizer(len(q))
        best: list[tuple[float, int]] = []
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                scores = quantizer.score(part.column(1).to_pylist(), q)
                best = sorted([*best, *zip((-np.round(scores, 6)).tolist(), part.column(0).to_pylist(), strict=True)])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([i for _, i in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())], ["id", "score"])

    found = table.select(F.col(id_column).cast("long"), code).mapInArrow(run, "id bigint, score double")
    return found.orderBy(F.desc("score"), "id").limit(k)


def scan_batch(table: DataFrame, queries: DataFrame, k: int, dim: int, refine: int = 4, id_column: str = "vec_id", embedding: str = "embedding", code: str = "turbo_code") -> DataFrame:
    """(query_id, vec_id, score, rank) of every query (query_id, embedding): refine * k by estimated cosine, of these k by exact cosine."""

    def make_score(q: np.ndarray):
        quantizer = Quantizer(dim)
        asked = quantizer.asked(q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))

        def score(batch: pa.RecordBatch, least: np.ndarray):
            for part in vector._parts(batch):
                rows, length = quantizer.parts(part.column(1).to_pylist())
                rows /= np.maximum(length, 1e-300)[:, None]
                for some in vector._blocks(len(asked), len(rows)):
                    yield some, part.column(0).to_numpy(), asked[some] @ rows.T

        return score

    near = vector.batched(table.select(F.col(id_column).cast("long"), code), queries, refine * k, make_score).select("query_id", "vec_id")
    return vector.rescored(near, table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")), queries, k)


def boosts(candidates: DataFrame, query: list[float], id_column: str = "id", code: str = "turbo_code") -> DataFrame:
    """(id, boost) of candidates; 0 where the code is missing or corrupt."""
    q = np.array(query, dtype=np.float64)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        quantizer = Quantizer(len(q))
        for s in parts:
            yield pd.Series(quantizer.score(list(s), q))

    return candidates.select(F.col(id_column).alias("id"), run(F.col(code)).alias("boost"))
