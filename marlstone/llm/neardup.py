"""Operator 6: near-duplicates by consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles: weight = occurrences * (1 + mean idf of the words), with idf the
log of N / df, scaled by log N to 0..1, where df counts the documents of the whole corpus that hold the word. The counts
stand in a count-min sketch of ``DEPTH`` rows of 2 ** ``IDF_BITS`` cells, so what the tasks are sent has a fixed size;
rare words that share cells weigh a little less than they should, the same in all documents. (Shingle counts of their own
would let a large group of copies devalue all that its members share, so that their differences alone would decide.)

Improved consistent weighted sampling draws for each sample the shingle and level that minimise Ioffe's a-value; equal
draws have the probability of the weighted Jaccard similarity. ``ROWS`` draws make a band, ``BANDS`` bands a signature;
at similarity 0.8 a pair shares a band with probability above 0.99.

Documents of equal text are one node. In every band's bucket the members are first compared with one of them; the
verified pairs (exact weighted Jaccard of whole texts) are linked and contracted to components. While a bucket holds
more than one component, a member not taken before is compared with those outside its component, ``ROUNDS`` times, which
joins large groups of copies cheaply. Then all pairs of a bucket that are neither tested nor in one component by now are
compared, in cells of two blocks of about ``buckets.BLOCK`` members. So each two texts that share a bucket are compared or
linked by others; of m texts that are all unlike each other, that is m squared / 2 comparisons.

Texts without words (null, empty, punctuation) are near only to equal texts; a null doc_id counts as the least id;
repeated rows are documents of one node; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.buckets import jaccard, link
from marlstone.llm.common import Scratch, slices, unused
from marlstone.llm.shingles import SHINGLE, Tokens, combine, mix, portions

THRESHOLD = 0.8
BANDS, ROWS = 8, 3
ROUNDS = 4
DEPTH, IDF_BITS = 2, 19
BITMAP_BITS = 25
NULL_ID = -(1 << 63)

#: Gamma(2, 1) and its logarithm by 16 bits of a hash: quantiles at the middles of 65536 equal parts.
_PARTS = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    u = (np.arange(_PARTS) + 0.5) / _PARTS
    x = np.sqrt(2 * u) + u  # Newton's method on 1 - (1 + x) e^-x = u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return x


_tables: list[np.ndarray] = []


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        g = _gamma_quantiles()
        _tables.extend([g.astype(np.float32), np.log(g).astype(np.float32)])
    return _tables[0], _tables[1]


def text_node(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


def _cells(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of the sketch the cells of the words."""
    for row in range(DEPTH):
        yield ((hashes >> np.uint64(row * IDF_BITS)) & np.uint64((1 << IDF_BITS) - 1)).astype(np.int64) + (row << IDF_BITS)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(DEPTH << IDF_BITS, dtype=np.int64)
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for part in portions(texts):
            tokens = Tokens(texts[part])
            order = np.lexsort((tokens.hashes, tokens.text))
            own, word = tokens.text[order], tokens.hashes[order]
            distinct = np.ones(len(word), dtype=bool)
            distinct[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
            for cells in _cells(word[distinct]):
                np.add.at(counts, cells, 1)
    used = np.flatnonzero(counts)
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["cell", "n"])


def word_idf(docs: DataFrame) -> np.ndarray:
    """The sketch's cells as scaled idf (0 to 1): the log of N / df by the log of N."""
    n = max(docs.count(), 2)
    found = docs.select("text").mapInArrow(_word_counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("df")).toArrow()  # of fixed size
    df = np.ones(DEPTH << IDF_BITS)
    df[found.column("cell").to_numpy()] = found.column("df").to_numpy()
    return np.clip(np.log(n / df) / np.log(n), 0, 1).astype(np.float32)


class Weigher:
    """Turns texts into weighted sets of shingles."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def weighted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and weights of the texts' sets, one after the other, and where each ends."""
        tokens = Tokens(texts)
        h, sizes = tokens.hashes, np.diff(tokens.first)
        values = np.max([self.idf[c] for c in _cells(h)], axis=0).astype(np.float64)
        n = max(len(h) - SHINGLE + 1, 0)
        own = tokens.text[:n]
        full = np.flatnonzero(np.arange(n) + SHINGLE <= tokens.first[own + 1])
        keys, own = combine(h)[full] if n else h[:0], own[full]
        # Word by word, so that a shingle weighs the same wherever it stands.
        rarity = sum(values[full + i] for i in range(SHINGLE)) / SHINGLE
        short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        if len(short):
            parts = [slice(tokens.first[i], tokens.first[i + 1]) for i in short]
            keys = np.concatenate([keys, *[combine(h[p]) for p in parts]])
            own = np.concatenate([own, short])
            rarity = np.concatenate([rarity, [values[p].mean() for p in parts]])
        order = np.lexsort((keys, own))
        keys, own, rarity = keys[order], own[order], rarity[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
        at = np.flatnonzero(first)
        counts = np.diff(np.append(at, len(keys)))
        return keys[at], counts * (1 + rarity[at]), np.searchsorted(own[at], np.arange(len(texts)), "right")

    def sets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for part in portions(texts):
            keys, weights, ends = self.weighted(texts[part])
            out += zip(np.split(keys, ends[:-1]), np.split(weights, ends[:-1]), strict=True)
        return out


def band_keys(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> np.ndarray:
    """(documents, bands) of 64-bit keys. The documents' sets stand one after the other from ``starts``; none is empty."""
    gamma, log_gamma = _quantiles()
    rng = np.random.default_rng(seed)
    salts = rng.integers(1 << 62, size=(bands * rows, 2), dtype=np.uint64)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    log_w = np.log(weights).astype(np.float32)
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    for k in range(bands * rows):
        x = (keys ^ salts[k, 0]) * (salts[k, 1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        r = gamma[(x >> np.uint64(48)).astype(np.intp)]
        c = log_gamma[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)]
        beta = ((x & np.uint64(0xFFFFFFFF)).astype(np.float32)) * np.float32(2.0**-32)
        t = np.floor(log_w / r + beta)
        a = c - r * (t - beta) - r
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[owner])
        at = at[np.unique(owner[at], return_index=True)[1]]
        drawn = mix(keys[at] ^ (t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        band = k // rows
        out[:, band] = mix(out[:, band] * np.uint64(31) + drawn + np.uint64(band + 1))
    return out


def _signatures(held, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(held.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found: list = []
            for part in portions(texts):
                keys, weights, ends = weigher.weighted(texts[part])
                starts = np.concatenate([[0], ends[:-1]])
                full = np.flatnonzero(ends > starts)
                signed = iter(band_keys(keys, weights, starts[full], bands, rows).astype(np.int64).tolist() if len(full) else [])
                found += [next(signed) if e > s else [] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([text_node(t) for t in texts], pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "bands"]
            )

    return run


def _verify(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(held.value)
        for batch in slices(batches):
            a, texts_a, texts_b = (batch.column(i).to_pylist() for i in (0, 2, 3))
            # One text stands in many pairs that follow each other.
            at, distinct = [], []
            for i, node in enumerate(a):
                if not i or node != a[i - 1]:
                    distinct.append(texts_a[i])
                at.append(len(distinct) - 1)
            sets = weigher.sets(distinct)
            good = [jaccard(sets[i], b) >= threshold for i, b in zip(at, weigher.sets(texts_b), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])

    return run


def _weigh_one(held):
    def make():
        weigher = Weigher(held.value)
        return lambda text: weigher.sets([text])[0]

    return make


def _bit(node: Column, doc_id: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(node, doc_id), F.lit(1 << bits))


def _bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size of the nodes and their least ids; a superset passes it."""
    at = _bit(F.col("node"), F.col("least_id"), bits)
    parts = nodes.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS int))")).alias("mask"))
    rows = parts.toPandas()  # at most 2^(bits - 5) rows
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).astype(np.uint32)
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, node, class_id, class_size, stands) for every row: the class's least doc_id, its number of rows, and
    whether the row, or an equal one, is to stand for the class."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    idf = spark.sparkContext.broadcast(word_idf(docs))
    signed = scratch.save(docs.select("doc_id", "text").mapInArrow(_signatures(idf, bands, rows), "doc_id bigint, node binary, bands array<bigint>"))
    nodes = signed.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least_id"), F.min("doc_id").alias("known_id"), F.count("*").alias("n_rows"))
    banded = signed.select("node", F.explode("bands").alias("key")).distinct()
    # Written before the join, so that AQE can split a hot bucket there.
    shared = scratch.save(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    members = scratch.save(banded.join(shared, "key").select("key", "node"))
    candidates = scratch.save(members.select("node").distinct().join(nodes.select("node", "least_id"), "node"))
    held = spark.sparkContext.broadcast(_bitmap(candidates, BITMAP_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        for batch in slices(batches):
            at = batch.column(0).to_numpy()
            hit = (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
            yield pa.RecordBatch.from_arrays(batch.columns[1:], ["node", "doc_id", "text"]).filter(pa.array(hit))

    # Texts of the candidates, once each: hashed in Python as the nodes were, and matched with the bitmap there. Of the
    # documents of a node only that of the least id passes, so that copies of a text do not meet in one task.
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([text_node(t) for t in texts], pa.binary()), batch.column(0), pa.array(texts, pa.string())], ["node", "doc_id", "text"])

    noded = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(hashed, "node binary, doc_id bigint, text string")
    near = noded.select(_bit(F.col("node"), F.col("doc_id"), BITMAP_BITS).alias("at"), "node", "doc_id", "text").mapInArrow(fetch, "node binary, doc_id bigint, text string")
    wanted = candidates.select("node", F.col("least_id").alias("doc_id"))
    texts = scratch.save(near.join(wanted, ["node", "doc_id"], "left_semi").dropDuplicates(["node", "doc_id"]).select("node", "text"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(_verify(idf, threshold), "a binary, b binary, good boolean")

    labels = link(members, texts.withColumnRenamed("text", "item"), verify, _weigh_one(idf), threshold, rounds, scratch)
    classed = scratch.save(nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # The row that stands for the class: of least id, a null one only where no row has an id; of equal ids the least node.
    first = F.min(F.struct(F.col("known_id").isNull().alias("unknown"), F.coalesce("known_id", F.lit(NULL_ID)).alias("m_doc"), "node")).alias("first")
    sizes = scratch.save(classed.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("n_rows").alias("class_size"), first))
    of_node = scratch.save(classed.join(sizes, "component").select("node", "class_id", "class_size", "first"))
    null_id = F.when(F.col("class_id") == NULL_ID, F.lit(None).cast("bigint")).otherwise(F.col("class_id"))
    stands = (F.col("first.node") == F.col("node")) & (F.col("first.m_doc") == F.coalesce("doc_id", F.lit(NULL_ID)))
    return signed.select("doc_id", "node").join(of_node, "node").select("doc_id", "node", null_id.alias("class_id"), "class_size", stands.alias("stands"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (the class's least doc_id), class_size, kept."""
    found = classes(docs, **options)
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _with_node(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = [text_node(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, name])

    return run


def neardup_stage(docs: DataFrame, **options) -> DataFrame:
    """A pipeline stage: exactly one row of each class, all columns kept: that of the least doc_id, one without an id only
    where no row of the class has one. Where an id is repeated or null, rows are told apart by their text as well."""
    scratch = Scratch(docs.sparkSession, "neardup")
    doc, node, number, kept_id, at, word, mask = (unused(n, docs) for n in ("m_doc", "m_node", "m_n", "m_any", "m_at", "m_word", "m_mask"))
    found = classes(docs, **options).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(doc), F.col("node").alias(node), "stands")
    standing = scratch.save(found.where("stands").select(doc, node).distinct())
    # All ids but those of a single row that stays: only rows whose bit one of them has are shuffled.
    ids = found.groupBy(doc).agg(F.count("*").alias(number), F.max("stands").alias(kept_id))
    special = scratch.save(ids.where(~F.col(kept_id) | (F.col(number) > 1)))
    bit = F.pmod(F.xxhash64(doc), F.lit(1 << BITMAP_BITS))
    own = F.expr(f"shiftleft(1L, cast({at} & 63 AS int))")
    bitmap = special.select(bit.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(own).alias(mask))
    bitmap = scratch.save(bitmap.coalesce(1))  # at most 2^(BITMAP_BITS - 6) rows
    rows = docs.withColumn(doc, F.coalesce("doc_id", F.lit(NULL_ID))).withColumn(at, bit).withColumn(word, F.shiftright(at, 6))
    rows = rows.join(F.broadcast(bitmap), word, "left")
    hit = F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(own) != 0
    single = rows.where(~hit).select(*docs.columns)
    kept = rows.where(hit).select(*docs.columns, doc).join(special, doc, "left").where(F.coalesce(F.col(kept_id), F.lit(True)))
    if special.where(kept_id).isEmpty():
        return single.unionByName(kept.select(*docs.columns))
    repeated = kept.where(kept_id).select(*docs.columns, doc)
    schema = T.StructType([*repeated.schema.fields, T.StructField(node, T.BinaryType())])
    repeated = repeated.mapInArrow(_with_node(node), schema).join(standing, [doc, node], "left_semi").dropDuplicates([doc, node])
    return single.unionByName(kept.where(F.col(kept_id).isNull()).select(*docs.columns)).unionByName(repeated.select(*docs.columns))
