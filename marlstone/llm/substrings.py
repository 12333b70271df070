"""Operator 5: passages that repeat across documents, by paragraph MinHash banding.

Paragraphs are taken at two sizes. The lines of at least ``LEAST_RUN`` words are compared by similarity: MinHash over
five-word shingles in bands, exact Jaccard similarity of lines that meet in a band, and connected components of the
links. Since a passage may also stand in the middle of lines or cover many short ones, each document is cut into pieces
as well, at the words whose hash is least among their ``REACH`` neighbours on either side and at its ends; the cuts
depend on the words around them alone, so a repeated passage has the same pieces wherever it stands, and pieces are
compared for equality. REACH is so small that a passage of over 50 words nearly always holds whole pieces; where
``LONGEST`` words have no cut, cuts are set at even distances.

A line or piece repeats if its class occurs in more than one document. The repeating lines and pieces of a document are
joined to runs of words; runs of at least ``LEAST_RUN`` words are reported. The document of least doc_id keeps its
occurrence; all others are to be removed. A run begins and ends at a cut or at the ends of a line, so of a passage in
the middle of lines the words before its first cut and after its last, about six on either side, are not in the run.

Bands are tuned: of all band shapes whose recall at the threshold is high enough, the one that needs the fewest hashes.
In a band's bucket lines are compared with one of them, ``ROUNDS`` times, and then all pairs that are neither tested nor
in one component by now, in blocks. Texts of candidate lines are fetched once, through a bitmap of fixed size.

Only hashes are shuffled: those of pieces first, summed within tasks, to find which repeat; then they are taken from the
texts again, with their places, and joined with the repeating ones, where AQE can split a hot one.

A document is a row's doc_id and text: rows that are equal in both are the same document, rows of one doc_id with
different texts are different documents, of which each has its own spans (``row_hash``). A null doc_id is the least;
documents that share a class's least doc_id all keep their occurrences. Null and empty texts have no paragraphs; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.buckets import link
from marlstone.llm.common import Scratch, slices
from marlstone.llm.shingles import SHINGLE, Tokens, combine, mix, portions, sequence_hashes, sums

THRESHOLD = 0.8
RECALL = 0.98
ROUNDS = 2
REACH = 4
LONGEST = 64
LEAST_WORDS = 5
LEAST_RUN = 28
BITMAP_BITS = 25
NULL_ID = -(1 << 63)
_LINE = np.uint64(0xA0761D6478BD642F)


def tune_bands(threshold: float, recall: float, most_rows: int = 6, most_bands: int = 64) -> tuple[int, int]:
    """(bands, rows) with the fewest false candidates among those that reach the recall with at most 12 hashes; else the fewest hashes."""
    shapes = [(b, r) for r in range(1, most_rows + 1) for b in range(1, most_bands + 1) if 1 - (1 - threshold**r) ** b >= recall]
    small = [s for s in shapes if s[0] * s[1] <= 12]
    return max(small, key=lambda s: (s[1], -s[0])) if small else min(shapes, key=lambda s: s[0] * s[1])


BANDS, ROWS = tune_bands(THRESHOLD, RECALL)


def minhash(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 9) -> np.ndarray:
    """(lines, bands) of keys; a line's shingles stand from starts to ends, one at least."""
    salts = np.random.default_rng(seed).integers(1 << 62, size=(bands * rows, 2), dtype=np.uint64)
    padded = np.append(shingles, np.uint64(0))
    at = np.stack([starts, ends], axis=1).ravel()
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    for k, (salt, factor) in enumerate(salts):
        least = np.minimum.reduceat((padded ^ salt) * (factor | np.uint64(1)), at)[::2] if len(at) else out[:, 0]
        band = k // rows
        out[:, band] = mix(out[:, band] * np.uint64(31) + least + np.uint64(band + 1))
    return out.astype(np.int64)


def cuts(tokens: Tokens, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Words that begin a piece: where the hash of two words is below those before and not above those after, and the ends of texts."""
    pairs = combine(tokens.hashes, 2) if len(tokens.hashes) > 1 else tokens.hashes
    n = len(pairs)
    found = np.empty(0, dtype=np.int64)
    if n > 2 * reach:
        mid = pairs[reach : n - reach]
        low = np.ones(len(mid), dtype=bool)
        for d in range(1, reach + 1):
            low &= (mid < pairs[reach - d : n - reach - d]) & (mid <= pairs[reach + d : n - reach + d])
        at = np.flatnonzero(low) + reach
        own = tokens.text[at]
        # A text's own words only decide.
        found = at[(at - tokens.first[own] >= reach) & (at + reach <= tokens.first[own + 1] - 2)]
    found = np.union1d(found, tokens.first)
    more = np.diff(found) // longest
    if more.any():
        begin = np.repeat(found[:-1], more)
        nth = np.arange(len(begin)) - np.repeat(np.cumsum(more) - more, more) + 1
        found = np.union1d(found, begin + nth * (longest // 2))
    return found


def pieces(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, end words and hashes of the pieces."""
    at = cuts(tokens)
    starts, ends = at[:-1], at[1:]
    keep = ends - starts >= LEAST_WORDS
    starts, ends = starts[keep], ends[keep]
    return starts, ends, sequence_hashes(sums(tokens.hashes), starts, ends).astype(np.int64)


def lines(tokens: Tokens, least: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, end words and hashes of the lines of at least so many words."""
    line = tokens.line
    edges = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [len(line)]]) if len(line) else np.zeros(1, np.int64)
    starts, ends = edges[:-1], edges[1:]
    keep = ends - starts >= max(least, SHINGLE)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, (sequence_hashes(sums(tokens.hashes), starts, ends) ^ _LINE).astype(np.int64)


def row_hashes(doc_ids: list, texts: list[str]) -> np.ndarray:
    """Of doc_id and text."""
    found = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), (d if d is not None else NULL_ID) & ((1 << 64) - 1)) for d, t in zip(doc_ids, texts, strict=True)]
    return np.array(found, dtype=np.uint64).astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Tokens]]:
    """Row hashes, doc_ids and words of portions of (doc_id, text)."""
    for batch in slices(batches):
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for part in portions(texts):
            yield row_hashes(ids[part], texts[part]), np.array([NULL_ID if d is None else d for d in ids[part]], dtype=np.int64), Tokens(texts[part])


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, ids, tokens in _portions(batches):
        starts, _, digests = pieces(tokens)
        own = tokens.text[starts]
        yield _batch({"digest": digests, "row_hash": rows[own], "doc_id": ids[own]})


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, ids, tokens in _portions(batches):
        starts, ends, digests = lines(tokens)
        own = tokens.text[starts]
        keys = minhash(combine(tokens.hashes), starts, ends - SHINGLE + 1)
        yield _batch({"digest": digests, "row_hash": rows[own], "doc_id": ids[own]} | {f"band{b}": keys[:, b].copy() for b in range(BANDS)})


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and lines with first and end word, and first and end code point, each two in one number."""
    for rows, ids, tokens in _portions(batches):
        starts, ends, digests = (np.concatenate(x) for x in zip(pieces(tokens), lines(tokens), strict=True))
        own = tokens.text[starts]
        first = tokens.first[own]
        spots = tokens.starts[starts] << 32 | tokens.ends[ends - 1]
        yield _batch({"digest": digests, "row_hash": rows[own], "doc_id": ids[own], "words": (starts - first) << 32 | (ends - first), "spots": spots})


def _shingles_of(bitmap_held):
    """(digest, shingles) of the lines whose digest is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bitmap_held.value
        seen: set[int] = set()  # a line that many documents hold leaves a task once
        for _, _, tokens in _portions(batches):
            starts, ends, digests = lines(tokens)
            at = digests & ((1 << BITMAP_BITS) - 1)
            hit = (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
            found, kept = combine(tokens.hashes), []
            for a, b, digest in zip(starts[hit].tolist(), ends[hit].tolist(), digests[hit].tolist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    kept.append((digest, np.unique(found[a : b - SHINGLE + 1]).astype(np.int64)))
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([v for _, v in kept], pa.list_(pa.int64()))], ["digest", "shingles"])

    return run


def _bitmap(digests: DataFrame) -> np.ndarray:
    at = F.col("digest").bitwiseAND((1 << BITMAP_BITS) - 1)
    parts = digests.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS int))")).alias("mask"))
    rows = parts.toPandas()  # at most 2^(BITMAP_BITS - 5) rows
    out = np.zeros(1 << (BITMAP_BITS - 5), dtype=np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).astype(np.uint32)
    return out


def _weigh():
    return lambda shingles: (np.array(shingles, dtype=np.int64), np.ones(len(shingles)))


def _classes(banded: DataFrame, docs: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(digest, component) of the lines that share a band with another; similar ones of a band are in one component.

    ``banded`` has digest and the bands' keys, once for each line of equal words.
    """
    banded = banded.select(F.col("digest").alias("node"), F.explode(F.array(*[f"band{b}" for b in range(BANDS)])).alias("key"))
    # Written before the join, so that AQE can split a hot bucket there.
    shared = scratch.save(banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"))
    members = scratch.save(banded.join(shared, "key").select("key", "node"))
    candidates = scratch.save(members.select(F.col("node").alias("digest")).distinct())
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(candidates))
    fetched = docs.select("doc_id", "text").mapInArrow(_shingles_of(held), "digest bigint, shingles array<bigint>")
    texts = scratch.save(fetched.join(candidates, "digest", "left_semi").dropDuplicates(["digest"]))

    def verify(pairs: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect("item_a", "item_b"))
        return pairs.select("a", "b", (shared >= threshold * (F.size("item_a") + F.size("item_b") - shared)).alias("good"))

    items = texts.select(F.col("digest").alias("node"), F.col("shingles").alias("item"))
    return link(members, items, verify, _weigh, threshold, ROUNDS, scratch).withColumnRenamed("node", "digest")


_RUNS = "doc_id bigint, start bigint, end bigint, n_words bigint, class_id bigint, removed boolean, row_hash bigint"


def _runs(least_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row, doc, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for removed in (False, True):
                    joined: list[list[int]] = []
                    for p in sorted((p["words"], p["spots"], p["class_id"]) for p in places if (p["class_id"] != doc) == removed):
                        first, until, start, end = p[0] >> 32, p[0] & 0xFFFFFFFF, p[1] >> 32, p[1] & 0xFFFFFFFF
                        if joined and first <= joined[-1][1]:
                            last = joined[-1]
                            last[1], last[3], last[4] = max(last[1], until), max(last[3], end), min(last[4], p[2])
                        else:
                            joined.append([first, until, start, end, p[2]])
                    real = lambda d: None if d == NULL_ID else d
                    out += [(real(doc), j[2], j[3], j[1] - j[0], real(j[4]), removed, row) for j in joined if j[1] - j[0] >= least_run]
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.bool_() if k == 5 else pa.int64() for k in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _RUNS.split(", ")])

    return run


def repeats(docs: DataFrame, threshold: float = THRESHOLD, least_run: int = LEAST_RUN) -> DataFrame:
    """One row per repeating run of a document: doc_id, start, end (code points), n_words, class_id, removed, row_hash.

    class_id is the least doc_id that holds the passage; removed is false there alone.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = docs.select("doc_id", "text")
    held_by = [F.min("doc_id").alias("least"), F.min("row_hash").alias("one"), F.max("row_hash").alias("other")]
    found = rows.mapInArrow(_piece_rows, "digest bigint, row_hash bigint, doc_id bigint")
    repeated = scratch.save(found.groupBy("digest").agg(*held_by).where("one <> other").select("digest", F.col("least").alias("class_id")))
    bands = [f"band{b}" for b in range(BANDS)]
    lined = rows.mapInArrow(_line_rows, f"digest bigint, row_hash bigint, doc_id bigint, {', '.join(f'{b} bigint' for b in bands)}")
    spread = scratch.save(lined.groupBy("digest").agg(*held_by, *[F.max(b).alias(b) for b in bands]))
    scratch.release()
    classes = _classes(spread.select("digest", *bands), docs, scratch, threshold)
    # A line in no component stands for itself.
    placed = spread.join(classes, "digest", "left").select("least", "one", "other", "digest", F.coalesce("component", "digest").alias("component"))
    of_class = scratch.save(placed.groupBy("component").agg(F.min("least").alias("class_id"), F.min("one").alias("one"), F.max("other").alias("other")).where("one <> other"))
    lines_too = scratch.save(placed.join(of_class.select("component", "class_id"), "component").select("digest", "class_id"))
    scratch.release()
    places = rows.mapInArrow(_place_rows, "digest bigint, row_hash bigint, doc_id bigint, words bigint, spots bigint")
    hits = places.join(repeated.unionByName(lines_too), "digest")
    # Equal rows are one document: their places are a set.
    of_row = hits.groupBy("row_hash", "doc_id").agg(F.collect_set(F.struct("words", "spots", "class_id")).alias("places"))
    return of_row.mapInArrow(_runs(least_run), _RUNS)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given spans."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out.append(text[at : max(at, start)])
            at = end
    return "".join(out) + text[at:]


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = row_hashes(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["doc_id", "text", "row_hash"])


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) of every row, with the removed runs of repeats() cut out."""
    spans = found.where("removed").groupBy(F.col("row_hash").alias("m_row")).agg(F.collect_list(F.struct("start", "end")).alias("m_spans"))
    hashed = docs.select("doc_id", "text").mapInArrow(_with_hash, "doc_id bigint, text string, row_hash bigint")
    joined = hashed.join(spans, F.col("row_hash") == F.col("m_row"), "left").select("doc_id", "text", "m_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                t if not s or t is None else cut(t, [(x["start"], x["end"]) for x in s])
                for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return joined.mapInArrow(run, "doc_id bigint, text string")


