"""Operator 3: benchmark passages in documents, by CGK embeddings of item-sized windows.

The unit is the lower-cased word. A window of a document as long as an item is a leak of it if their edit distance is
at most (1 - threshold) of the item's words. Three steps find these windows:

1. Windows. If a window is that near, a run of at least (W - k) / (k + 1) of the item's W words stands in it unchanged
   (k edits cut W - k kept words into k + 1 runs); so only windows aligned by such a run, of at most ``ANCHOR`` words,
   are looked at. This loses no leak.
2. CGK random walks embed window and item so that few edits become few differing positions; a repetition hashes
   ``BITS`` sampled positions of its own walk, and a window goes on if any repetition agrees. The number of
   repetitions is set from the items: their words are edited as far as the threshold allows, the share of agreeing
   positions is measured, and repetitions are added until the target recall is reached; items that would need more than
   ``MOST_REPETITIONS`` skip this step, so all their windows go on.
3. The exact edit distance of the item to the best-fitting part of the surrounding words decides.

The walks could look at every window of a document, but a document has as many windows of each item length as words,
and each walk takes twice the item's words in steps: hundreds of times the cost of step 1, which is exact.

The items are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text, and every block meets all documents in
whole. Items of fewer than ``least_words`` words (five, a shingle, if not said otherwise) cannot be told from chance and
match nothing, as null ones; with least_words = 1 all are searched. Null and empty documents leak nothing; repeated rows are reported each; a null doc_id is reported as null; no items or documents give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import slices
from marlstone.llm.shingles import Tokens, combine, mix, portions

THRESHOLD = 0.8
RECALL = 0.99
LEAST_WORDS = 5
ANCHOR = 3
BITS = 2
MOST_REPETITIONS = 512
#: Edited items on which the number of repetitions is set.
TUNE_EDITED = 192
BLOCK_BYTES = 8 << 20
SEED = 5
PAD = np.uint64(0)
_FILTER_BITS = 22


class Items:
    """A block of benchmark items, indexed for all three steps."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, recall: float = RECALL, least_words: int = LEAST_WORDS, seed: int = SEED):
        self.threshold = threshold
        found = words_of([text for _, text in items])
        kept = [i for i, w in enumerate(found) if len(w) >= max(least_words, 1)]
        self.ids, self.words = [items[i][0] for i in kept], [found[i] for i in kept]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.most_edits = [self.edits(n) for n in self.lengths.tolist()]
        self._anchors()
        self._embed(recall, seed)

    def edits(self, n: int) -> int:
        return int((1 - self.threshold) * n + 1e-9)

    def _anchors(self) -> None:
        """By run length: sorted hashes of the items' runs, with item and offset of each."""
        by_size: dict[int, list] = {}
        for i, w in enumerate(self.words):
            k = self.most_edits[i]
            size = min(ANCHOR, -(-(len(w) - k) // (k + 1)))
            runs = combine(w, size)
            by_size.setdefault(size, []).append((runs, np.full(len(runs), i), np.arange(len(runs))))
        self.anchors = {}
        for size, parts in by_size.items():
            keys, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bitmap[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.anchors[size] = (keys[order], item[order], offset[order], bitmap)

    def _walk(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray, repetitions: slice) -> np.ndarray:
        """(windows, repetitions) of hashed samples of the windows' CGK walks; lengths are the items' lengths."""
        at_steps = (self.samples[:, repetitions, None] * (2 * lengths)).astype(np.int64)  # bits, repetitions, windows
        salts = self.salts[:, repetitions]
        n = at_steps.shape[1]
        pos = np.broadcast_to(starts, (n, len(starts))).copy()
        out = np.zeros((n, len(starts)), dtype=np.uint64)
        last = len(tokens) - 1
        for step in range(int(at_steps.max(initial=-1)) + 1):
            inside = pos < ends
            symbol = np.where(inside, tokens[np.minimum(pos, last)], PAD)
            for b in range(BITS):
                due = at_steps[b] == step
                if due.any():
                    out = np.where(due, out ^ mix(symbol + np.uint64(b + 1)), out)
            bit = ((symbol ^ salts[step][:, None]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
            pos += bit.astype(np.int64)
        return out.T

    def _embed(self, recall: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        longest = int(self.lengths.max(initial=1))
        edited = [(i, self._edited(self.words[i].tolist(), self.most_edits[i], rng)) for i in (rng.integers(len(self.words), size=TUNE_EDITED).tolist() if self.words else [])]
        n = 16
        while True:
            draw = np.random.default_rng(seed + 1)
            # Repetition by repetition, so that more of them leave the first ones as they are.
            drawn = [(draw.integers(1 << 63, size=2 * longest + 1, dtype=np.uint64), draw.random(BITS)) for _ in range(n)]
            self.salts, self.samples = (np.stack(x, axis=1) for x in zip(*drawn, strict=True))
            everything = slice(0, n)
            whole = lambda w, length: self._walk(w, np.array([0]), np.array([min(len(w), length)]), np.array([length]), everything)
            self.keys = np.concatenate([whole(w, len(w)) for w in self.words]) if self.words else np.zeros((0, n), np.uint64)
            # Edited as far as allowed: the repetitions that most of such items need.
            agree = np.stack([(whole(w, len(self.words[i]))[0] == self.keys[i]).cumsum() > 0 for i, w in edited]) if edited else np.ones((1, n), dtype=bool)
            enough = np.flatnonzero(agree.mean(axis=0) >= recall)
            if len(enough) or n >= MOST_REPETITIONS:
                break
            n *= 2
        self.repetitions = int(enough[0]) + 1 if len(enough) else n
        self.keys = self.keys[:, : self.repetitions]
        # Items whose edited forms agree too seldom go on to the exact distance in any case.
        self.skip = np.zeros(len(self.words), dtype=bool)
        if not len(enough):
            self.skip[[i for (i, _), ok in zip(edited, agree[:, -1], strict=True) if not ok]] = True

    @staticmethod
    def _edited(w: list[int], n: int, rng: np.random.Generator) -> np.ndarray:
        for _ in range(n):
            at = int(rng.integers(len(w)))
            kind = rng.integers(3)
            if kind == 0:
                w[at] = int(rng.integers(1 << 62))
            elif kind == 1:
                w.insert(at, int(rng.integers(1 << 62)))
            elif len(w) > 1:
                del w[at]
        return np.array(w, dtype=np.uint64)

    def candidates(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, starts and documents of the windows that step 1 leaves; starts may lie up to k words outside.

        The documents' words stand one after the other; ``ends`` has where each ends.
        """
        found = []
        for size, (keys, item, offset, bitmap) in self.anchors.items():
            if len(tokens) < size:
                continue
            runs = combine(tokens, size)
            at = np.flatnonzero(bitmap[(runs & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
            doc = np.searchsorted(ends, at, "right")
            n = np.where(at + size <= ends[doc], hi - lo, 0)
            total = int(n.sum())
            if total:
                rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                found.append(np.stack([item[rows], np.repeat(at, n) - offset[rows], np.repeat(doc, n)]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def agreeing(self, tokens: np.ndarray, items: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Step 2, for many windows at a time."""
        out = np.zeros(len(items), dtype=bool)
        for i in range(0, len(items), 4096):
            part = slice(i, i + 4096)
            todo = np.arange(len(items[part]))
            for r in range(0, self.repetitions, 8):
                reps = slice(r, min(r + 8, self.repetitions))
                mine = items[part][todo]
                keys = self._walk(tokens, begin[part][todo], end[part][todo], self.lengths[mine], reps)
                hit = (keys == self.keys[mine, reps]).any(axis=1)
                out[i + todo[hit]] = True
                todo = todo[~hit]
                if not len(todo):
                    break
        return out

    def leaks(self, documents: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each document (item, first word, end word, distance) of the best window of each leaked item."""
        out: list[list] = [[] for _ in documents]
        ends = np.cumsum([len(d) for d in documents])
        tokens = np.concatenate(documents) if documents else np.empty(0, np.uint64)
        items, starts, docs = self.candidates(tokens, ends)
        if not len(items):
            return out
        first = ends - [len(d) for d in documents]
        good = self.skip[items]
        good[~good] = self.agreeing(tokens, items[~good], np.maximum(starts, first[docs])[~good], np.minimum(starts + self.lengths[items], ends[docs])[~good])
        items, starts, docs = items[good], (starts - first[docs])[good], docs[good]
        for d, i in np.unique(np.stack([docs, items]), axis=1).T.tolist():
            own, text = np.sort(starts[(items == i) & (docs == d)]), documents[d]
            k, n = self.most_edits[i], int(self.lengths[i])
            best = None
            # Windows that overlap are searched as one stretch of words.
            for group in np.split(own, np.flatnonzero(np.diff(own) > n + 2 * k) + 1):
                lo, hi = max(0, int(group[0]) - k), min(len(text), int(group[-1]) + n + k)
                distance, end = fit_distance(self.words[i], text[lo:hi])
                if distance <= k and (best is None or distance < best[2]):
                    _, length = fit_distance(self.words[i][::-1], text[lo : lo + end][::-1])
                    best = (lo + end - length, lo + end, distance)
            if best:
                out[d].append((i, *best))
        return out


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words."""
    out = []
    texts = [t or "" for t in texts]
    for part in portions(texts):
        tokens = Tokens(texts[part])
        out += np.split(tokens.hashes, tokens.first[1:-1])
    return out


def fit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to any part of text, and where the first such part ends."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, w in enumerate(item.tolist(), 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != w), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - at) + at
    end = int(row.argmin())
    return int(row[end]), end


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about block_bytes, one block on the driver at a time."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


_SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, distance bigint, item_words bigint, similarity double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per leaked item of a document, with the best-fitting span in code points."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(Items(block, threshold, recall, least_words))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in slices(batches):
                rows = []
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for part in portions(texts):
                    tokens = Tokens(texts[part])
                    leaks = index.leaks(np.split(tokens.hashes, tokens.first[1:-1]))
                    for doc_id, begin, found in zip(ids[part], tokens.first.tolist(), leaks, strict=False):
                        for i, first, end, distance in found:
                            n = int(index.lengths[i])
                            rows.append((doc_id, index.ids[i], int(tokens.starts[begin + first]), int(tokens.ends[begin + end - 1]), distance, n, 1 - distance / n))
                columns = zip(*rows, strict=True) if rows else [()] * 7
                kinds = [pa.int64()] * 6 + [pa.float64()]
                names = ["doc_id", "item_id", "start", "end", "distance", "item_words", "similarity"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        part = docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A pipeline stage: the documents without leaks, with all their columns."""
    for block in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(Items(block, threshold, recall))

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in slices(batches):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                leaks = [found for part in portions(texts) for found in index.leaks(words_of(texts[part]))]
                yield batch.filter(pa.array([not found for found in leaks], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def brute_force(texts: list[str | None], items: list[str | None], threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> set[tuple[int, int]]:
    """(document, item) of every leak, by the edit distance alone; for tests."""
    rows, wanted = words_of(texts), words_of(items)
    near = lambda w, t: len(t) and fit_distance(w, t)[0] <= int((1 - threshold) * len(w) + 1e-9)
    return {(d, i) for i, w in enumerate(wanted) if len(w) >= max(least_words, 1) for d, t in enumerate(rows) if near(w, t)}
