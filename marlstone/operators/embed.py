"""Passage embedding behind one interface: models are functions from texts to vectors, run in Arrow batches.

No model weights are part of this library; HashingModel is a deterministic stand-in with the same interface.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class HashingModel:
    """Signed feature hashing of words and word pairs, L2-normalised."""

    def __init__(self, dim: int = 64, seed: int = 0):
        self.dim, self.seed = dim, seed

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            for f in words + [a + " " + b for a, b in zip(words, words[1:], strict=False)]:
                h = xxhash.xxh64_intdigest(f.encode(), seed=self.seed)
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        return l2(out)


def l2(rows: np.ndarray) -> np.ndarray:
    """Unit rows; zero rows stay."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def pool(hidden: np.ndarray, mask: np.ndarray, kind: str = "mean") -> np.ndarray:
    """(batch, dim) from (batch, tokens, dim): the mean over unmasked tokens, or the first token; then unit length."""
    if kind == "cls":
        return l2(hidden[:, 0, :])
    weights = mask[:, :, None].astype(hidden.dtype)
    return l2((hidden * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9))


def pool_rows(df: DataFrame, dim: int, tokens: str = "tokens", held: str = "held", out: str = "pooled", kind: str = "mean") -> DataFrame:
    """Adds pool() of each row: tokens is the row-wise array of its token vectors, held how many of them count (at least one)."""

    @F.pandas_udf("array<double>")
    def run(hidden: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for h, k in zip(hidden, n, strict=True):
            rows = np.asarray(h, dtype=np.float64).reshape(1, -1, dim)
            out.append(pool(rows, (np.arange(rows.shape[1]) < k)[None, :], kind)[0])
        return pd.Series(out)

    return df.withColumn(out, run(F.col(tokens), F.col(held)))


# Prefixes by model family.
PREFIXES = {
    "e5": ("query: ", "passage: "),
    "bge": ("Represent this sentence for searching relevant passages: ", ""),
    "mxbai": ("Represent this sentence for searching relevant passages: ", ""),
    "nomic": ("search_query: ", "search_document: "),
    "instructor": ("Represent the question for retrieving supporting documents: ", "Represent the document for retrieval: "),
}


def prefixes(model_id: str) -> tuple[str, str]:
    """Prefix of queries and of passages."""
    return next((p for family, p in PREFIXES.items() if family in model_id.lower()), ("", ""))


def with_prefix(text: Column, mode: str, model_id: str) -> Column:
    """A passage (also when indexing) or a query as the model expects it."""
    query, passage = prefixes(model_id)
    return F.concat(F.lit(query if mode == "query" else passage), text)


def clip_bytes(text: str, cap: int) -> str:
    """The longest start of at most cap bytes, in whole characters."""
    return text.encode("utf-8", "surrogatepass")[: max(cap, 0)].decode("utf-8", "ignore")


def embed(df: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "content", out: str = "embedding", batch: int = 64, cap: int = 1 << 20) -> DataFrame:
    """Adds the vector of each text. A vector with a NaN, or a wrong number of vectors, fails the job."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [clip_bytes(t or "", cap) for t in s]
            vectors = []
            for i in range(0, len(texts), batch):
                got = np.asarray(model(texts[i : i + batch]), dtype=np.float32)
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("the model returned another number of vectors than texts")
                if np.isnan(got).any():
                    raise ValueError("the model returned NaN")
                vectors += list(got)
            yield pd.Series(vectors)

    return df.withColumn(out, run(F.col(text)))


def batches_within(sizes: list[int], most_items: int, most_bytes: int) -> list[list[int]]:
    """Indices in order, in batches of at most so many items and bytes (one larger item alone)."""
    out, room = [], 0
    for i, size in enumerate(sizes):
        if not out or len(out[-1]) == most_items or room + size > most_bytes:
            out.append([])
            room = 0
        out[-1].append(i)
        room += size
    return out


# Padded lengths in tokens, and the most texts of a batch.
PADDED_LENGTHS = (64, 128, 256, 512, 1024, 2048, 4096, 8192)
MOST_IN_BATCH = 64


def padded_batches(lengths: list[int], most_tokens: int, longest: int = PADDED_LENGTHS[-1]) -> list[tuple[int, list[int]]]:
    """(padded length, indices) of batches of texts of like length, short ones first, so that little is padded.

    A length goes up to the next padded one, ``longest`` at most; a batch holds a power of two of texts, at most
    ``MOST_IN_BATCH`` and as many as ``most_tokens`` padded tokens allow, but one at least.
    """
    padded = [min(next((p for p in PADDED_LENGTHS if p >= n), longest), longest) for n in lengths]
    out = []
    for p in sorted(set(padded)):
        size = 1 << min(MOST_IN_BATCH, max(most_tokens // p, 1)).bit_length() - 1
        own = [i for i, q in enumerate(padded) if q == p]
        out += [(p, own[at : at + size]) for at in range(0, len(own), size)]
    return out


def bucketed(model: Callable[[list[str]], np.ndarray], length: Callable[[str], int], most_tokens: int, longest: int = PADDED_LENGTHS[-1]) -> Callable[[list[str]], np.ndarray]:
    """A model that is given texts in padded_batches() and answers in the order asked."""

    def run(texts: list[str]) -> np.ndarray:
        rows: dict[int, np.ndarray] = {}
        for _, own in padded_batches([length(t) for t in texts], most_tokens, longest):
            rows.update(zip(own, model([texts[i] for i in own]), strict=True))
        return np.stack([rows[i] for i in range(len(texts))]) if texts else np.empty((0, 0))

    return run


@dataclass(frozen=True)
class RemoteModel:
    """A provider's model: ``post`` sends texts and returns their vectors. Requests of bounded items and bytes go out two
    at a time, answers come in order; a failed request is sent again after half a second, then twice as long each time."""

    post: Callable[[list[str]], list[list[float]]]
    most_items: int = 64
    most_bytes: int = 80_000
    retries: int = 4
    first_wait: float = 0.5
    longest_wait: float = 4.0
    at_once: int = 2

    def _sent(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            try:
                return self.post(texts)
            except (ConnectionError, TimeoutError, OSError):
                if attempt == self.retries:
                    raise
                time.sleep(min(self.first_wait * 2**attempt, self.longest_wait))
        raise AssertionError

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = batches_within([len(t.encode("utf-8", "surrogatepass")) for t in texts], self.most_items, self.most_bytes)
        with ThreadPoolExecutor(self.at_once) as pool:
            found = list(pool.map(self._sent, [[texts[i] for i in part] for part in parts]))
        return np.array([v for part in found for v in part], dtype=np.float64)


# Models that are known, with their parameters in millions.
MODELS = (
    ("jinaai/jina-embeddings-v2-base-code", 137.0),
    ("sentence-transformers/all-MiniLM-L6-v2", 22.7),
    ("sentence-transformers/all-MiniLM-L12-v2", 33.4),
    ("BAAI/bge-small-en-v1.5", 33.4),
    ("BAAI/bge-base-en-v1.5", 109.0),
    ("BAAI/bge-m3", 567.0),
    ("intfloat/e5-small-v2", 33.4),
    ("intfloat/e5-base-v2", 109.0),
    ("intfloat/multilingual-e5-small", 118.0),
    ("intfloat/multilingual-e5-base", 278.0),
    ("thenlper/gte-small", 33.4),
    ("thenlper/gte-base", 109.0),
    ("thenlper/gte-large", 335.0),
    ("mixedbread-ai/mxbai-embed-large-v1", 335.0),
    ("Alibaba-NLP/gte-Qwen2-7B-instruct", 7000.0),
    ("Alibaba-NLP/gte-Qwen2-1.5B-instruct", 1500.0),
    ("Alibaba-NLP/qwen3-embedding-4b", 4000.0),
    ("BAAI/bge-multilingual-gemma2", 9000.0),
    ("jinaai/jina-embeddings-v2-base-zh", 330.0),
    ("infgrad/stella-base-zh-v3", 102.0),
)


@dataclass(frozen=True)
class Profile:
    model_id: str
    pooling: str
    query_prefix: str
    passage_prefix: str
    longest: int


def profile(model_id: str, longest: int = 8192, tokenizer_longest: int | None = None, query_prefix: str | None = None, passage_prefix: str | None = None) -> Profile:
    """What a model needs: its pooling and prefixes by family, unless given, and the lesser of both limits of length."""
    query, passage = prefixes(model_id)
    limit = longest if tokenizer_longest is None else min(longest, tokenizer_longest)
    pooling = "cls" if "bge" in model_id.lower() else "mean"
    return Profile(model_id, pooling, query if query_prefix is None else query_prefix, passage if passage_prefix is None else passage_prefix, limit)


def catalogue(spark: SparkSession) -> DataFrame:
    """(model_id, parameters_m, pooling, query_prefix, passage_prefix) of the known models."""
    rows = [(m, n, p.pooling, p.query_prefix, p.passage_prefix) for m, n in MODELS for p in [profile(m)]]
    return spark.createDataFrame(rows, "model_id string, parameters_m double, pooling string, query_prefix string, passage_prefix string")


def chunk_budget(max_tokens: int, remote: bool) -> int:
    """Bytes a passage may hold: 8 a token for local models, 1 for remote ones (of at most 8192 tokens)."""
    return min(max_tokens, 8192) if remote else max_tokens * 8
