"""Operator 9: toxicity by a counterfactual-regularised classifier.

A document's features are the distinct words it holds and the distinct starts of its words (first 4 and 5 letters), of
the whole text. A sparse logistic model over them, whose weights are not negative (no word makes another less toxic),
is fitted with a second loss: in every labelled text that mentions
an identity term, the term is swapped for others of its category (the neutral one included), and the squared
difference of the log-odds of the text and of the swapped text is penalised; what the text's other words give stays. A group's name then cannot carry a toxic score by itself, which
spares neutral mentions.

The model is fitted on the driver on features of at most ``FIT_ROWS`` labelled documents; labels of held-out ids never
enter. Only features with a weight are kept for scoring, which reads whole texts. Without both classes among the
labels nothing can be learned: every score is 0 and no document is toxic.

Null and empty texts have no features; repeated rows get equal scores; a null doc_id is not held out; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import slices
from marlstone.llm.labelled import remainder, sample

FIT_ROWS = 4_000
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
LEAST_DOCS = 3
L1, COUNTERFACTUAL = 1.2e-4, 1.0
#: A toxic example counts as so many.
POSITIVE = 3.0
WORD = re.compile(r"\w+")

#: Interchangeable group names by category; the first of each is the neutral one.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("people", "gay", "lesbian", "bisexual", "straight", "queer"),
    ("people", "christian", "christians", "muslim", "muslims", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "atheists"),
    ("people", "black", "white", "asian", "latino", "african", "arab", "european", "immigrant", "immigrants", "refugees"),
    ("people", "blind", "deaf", "disabled", "old", "young", "elderly"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "immigrés"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "schwarze", "weiße", "ausländer"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos", "inmigrantes"),
)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """Words, and starts of words marked by a trailing '*' and their length."""
    return words | {w[:5] + "*5" for w in words if len(w) >= 5} | {w[:4] + "*4" for w in words if len(w) >= 4}


def feature_hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) >> 1  # fits a signed long


def hashed(words: set[str]) -> np.ndarray:
    """The hashes of a text's features; the fit needs no more of it."""
    return _hashes(features_of(words))


def swaps(words: set[str], terms: tuple[tuple[str, ...], ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each identity term of a text and each other term of its category the hashed features that go and that come by the swap."""
    out = []
    own = features_of(words)
    for category in terms:
        for term in category:
            if term in words:
                for other in category:
                    if other != term:
                        changed = features_of((words - {term}) | {other})
                        out.append((_hashes(own - changed), _hashes(changed - own)))
    return out


def _hashes(features: set[str]) -> np.ndarray:
    return np.array(sorted(map(feature_hash, features)), dtype=np.int64)


class Model:
    """Log-odds by feature; ``base`` is that of a text without any."""

    def __init__(self, base: float, weights: dict[str, float]):
        self.base = base
        self.words = {k: v for k, v in weights.items() if "*" not in k}
        self.five = {k[:-2]: v for k, v in weights.items() if k.endswith("*5")}
        self.four = {k[:-2]: v for k, v in weights.items() if k.endswith("*4")}

    def probability(self, words: set[str]) -> float:
        total = self.base
        for held, found in ((self.words, words), (self.five, {w[:5] for w in words if len(w) >= 5}), (self.four, {w[:4] for w in words if len(w) >= 4})):
            for f in found & held.keys():
                total += held[f]
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(
    documents: list[np.ndarray], labels: np.ndarray, swapped: list[list[tuple[np.ndarray, np.ndarray]]], l1: float = L1, counterfactual: float = COUNTERFACTUAL, steps: int = 120
) -> tuple[float, dict[int, float]]:
    """Fits by proximal gradient descent with momentum. Documents are hashed features, with the swaps of each; returns base and weights by hash."""
    n = len(documents)
    kinds, counts = np.unique(np.concatenate(documents), return_counts=True)
    pairs = [p for found in swapped for p in found if len(p[0]) or len(p[1])]
    named = np.unique(np.concatenate([np.empty(0, np.int64), *[side for p in pairs for side in p]]))
    kinds = np.union1d(kinds[counts >= LEAST_DOCS], named)
    m = len(kinds)

    def columns(found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(kinds, found), m - 1)
        return at[kinds[at] == found]

    rows = [columns(d).astype(np.int32) for d in documents] if m else []
    column = np.concatenate(rows) if rows else np.empty(0, np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows] if rows else 0)
    if pairs:
        # The difference of a text and its counterfactual version, as signed entries.
        parts = [(i, columns(side), sign) for i, pair in enumerate(pairs) for side, sign in zip(pair, (1.0, -1.0), strict=True)]
        d_owner = np.concatenate([np.full(len(c), i) for i, c, _ in parts])
        d_col = np.concatenate([c for _, c, _ in parts])
        d_sign = np.concatenate([np.full(len(c), sign) for _, c, sign in parts])
    # Frequent features are scaled down, so that the step size suits all.
    rate = 0.5 / np.sqrt(np.bincount(column, minlength=m) / n + 1e-3)
    w, velocity = np.zeros(m), np.zeros(m)
    weight = np.where(labels == 1, POSITIVE, 1.0) / n
    mean = (labels * weight).sum() / weight.sum()
    base = float(np.log(mean / (1 - mean)))
    for step in range(steps):
        look = w + 0.9 * velocity
        p = 1 / (1 + np.exp(-np.clip(base + np.bincount(owner, look[column], minlength=n), -30, 30)))
        error = (p - labels) * weight
        gradient = np.bincount(column, error[owner], minlength=m)
        if pairs:
            apart = np.bincount(d_owner, look[d_col] * d_sign, minlength=len(pairs))
            gradient += counterfactual * np.bincount(d_col, (2 * apart / len(pairs))[d_owner] * d_sign, minlength=m)
        at = rate * (1.0 if step < steps * 2 // 3 else 0.3)
        new = look - at * gradient
        new = np.maximum(new - at * l1, 0)
        velocity, w = new - w, new
        base -= 0.5 * float(error.sum())
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return base, dict(zip(kinds[kept].tolist(), w[kept].tolist(), strict=True))


def _hashed(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            found = [hashed(w).tobytes() for w in words]
            swapped = [[{"gone": g.tobytes(), "came": c.tobytes()} for g, c in swaps(w, terms)] for w in words]
            kind = pa.list_(pa.struct([("gone", pa.binary()), ("came", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(swapped, kind), batch.column(2)], ["doc_id", "features", "swaps", "label"])

    return run


def _names(wanted: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = {f for t in batch.column(1).to_pylist() for f in features_of(words_of(t)) if feature_hash(f) in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["feature"])

    return run


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, terms=IDENTITY_TERMS) -> Model | float:
    """A fitted model; 0 where the labels have fewer than two classes.

    The driver gets hashes of the sample's features; the names of those that are kept are read from the sample again.
    """
    picked = sample(docs, labels, "toxic", MODULUS, HELD_OUT, limit).select("doc_id", "text", "label")
    rows = picked.mapInArrow(_hashed(terms), "doc_id bigint, features binary, swaps array<struct<gone:binary,came:binary>>, label int").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return 0.0
    numbers = lambda b: np.frombuffer(b, dtype=np.int64)
    base, weights = train([numbers(r["features"]) for r in rows], y, [[(numbers(x["gone"]), numbers(x["came"])) for x in r["swaps"]] for r in rows])
    named = {r[0] for r in picked.mapInArrow(_names(weights), "feature string").distinct().collect()}
    named |= {f for category in terms for t in category for f in features_of({t})}
    return Model(base, {f: weights[h] for f in sorted(named) if (h := feature_hash(f)) in weights})


def _scored(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            values = [model if isinstance(model, float) else model.probability(words_of(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.float64())], ["doc_id", "m_score"])

    return run


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = docs.select("text", "doc_id").mapInArrow(_scored(model), "doc_id bigint, m_score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("m_score").alias("score"),
        (F.col("m_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, limit))


def toxicity_stage(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """A pipeline stage: the documents that are not toxic, with all their columns."""
    model = fit(docs, labels, limit)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            values = [model if isinstance(model, float) else model.probability(words_of(t or "")) for t in texts]
            yield batch.filter(pa.array([v < THRESHOLD for v in values]))

    return docs.mapInArrow(keep, docs.schema)
