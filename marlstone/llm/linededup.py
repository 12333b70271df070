"""Operator 10: drop repeated lines, found by probing a sharded minimal perfect hash.

Every distinct line key of a document (at least ``min_chars`` code points) is hashed to 128 bits. The keys that occur
in at least ``min_docs`` documents are laid out in shards by the hash's top bits; each shard holds a minimal perfect
hash (hash-and-displace: a pilot per small bucket of keys, so that all keys fall on different slots of an array as long
as there are keys) over arrays of 64-bit fingerprints, counts and largest doc_ids. Documents probe the arrays: pilot,
slot, fingerprint; lines are never joined to documents.

Arrays of at most ``BLOCK_BYTES`` in all, a size that is checked before, are broadcast. Larger ones stay where they are:
the line hashes of all documents are shuffled to them once, dealt by shard and, so that no hot line's probes meet in one
task, by parts of about ``PART_PROBES`` within a shard, each with the shard's arrays; the hits are gathered per document
before the texts are read a last time. A line that is not in the index is taken for one that is with probability 2^-64 a
probe.

A null or empty text is one empty line. A document is a doc_id: rows that share one count once for a line and share its
largest doc_id, so all of them keep or lose it. A null doc_id is smaller than every other. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, slices

BLANK = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 64 << 20
SHARD_KEYS = 20_000
PILOT_KEYS = 4
PART_PROBES = 1_000_000
NULL_ID = -(1 << 63)

_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: str, min_chars: int) -> bytes | None:
    """The key's UTF-8 bytes; None if it is too short to be dropped."""
    key = line.strip(BLANK)
    return key.encode().lower() if len(key) >= min_chars else None  # bytes.lower() changes A-Z only


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mix(low: np.ndarray, pilot: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = low ^ (np.uint64(pilot) if np.isscalar(pilot) else pilot.astype(np.uint64)) * _MIX
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


def build_shard(high: np.ndarray, low: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> dict:
    """A minimal perfect hash over one shard's keys, with its arrays in slot order."""
    n = len(low)
    n_buckets = max(1, -(-n // PILOT_KEYS))
    bucket = (low % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    pilots = np.zeros(n_buckets, dtype=np.uint32)
    taken = np.zeros(n, dtype=bool)
    slot_of = np.empty(n, dtype=np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        keys = order[starts[b] : starts[b + 1]]
        hashes = low[keys]
        pilot = 0
        while True:
            tries = np.arange(pilot, pilot + 64, dtype=np.uint64)
            slots = (_mix(hashes[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[slots].any(axis=1)
            for t in np.flatnonzero(free):
                if len(set(slots[t].tolist())) == len(keys):
                    pilots[b] = pilot + t
                    taken[slots[t]] = True
                    slot_of[keys] = slots[t]
                    break
            else:
                pilot += 64
                continue
            break
    out = {"pilots": pilots, "fingerprints": np.empty(n, np.uint64), "counts": np.empty(n, np.int64), "largest": np.empty(n, np.int64)}
    out["fingerprints"][slot_of] = high
    out["counts"][slot_of] = counts
    out["largest"][slot_of] = largest
    return out


class Index:
    """Shards by number; probe() gives count and largest doc_id of each hash, count 0 where it is absent."""

    def __init__(self, n_shards: int, shards: dict[int, dict]):
        self.n_shards, self.shards = n_shards, shards

    @staticmethod
    def shard_of(high: np.ndarray, n_shards: int) -> np.ndarray:
        return ((high >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)

    def probe(self, digests: bytes) -> tuple[np.ndarray, np.ndarray]:
        pair = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
        high, low = pair[:, 0], pair[:, 1]
        counts = np.zeros(len(pair), dtype=np.int64)
        largest = np.zeros(len(pair), dtype=np.int64)
        where = self.shard_of(high, self.n_shards)
        for s in np.unique(where):
            part = self.shards.get(int(s))
            if part is None:
                continue
            rows = np.flatnonzero(where == s)
            lo, pilots = low[rows], part["pilots"]
            pilot = pilots[(lo % np.uint64(len(pilots))).astype(np.int64)]
            slot = (_mix(lo, pilot) % np.uint64(len(part["fingerprints"]))).astype(np.int64)
            hit = part["fingerprints"][slot] == high[rows]
            counts[rows[hit]] = part["counts"][slot[hit]]
            largest[rows[hit]] = part["largest"][slot[hit]]
        return counts, largest


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        digests, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None}
            digests += [key_hash(k) for k in keys]
            ids += [NULL_ID if doc_id is None else doc_id] * len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64())], ["hash", "doc_id"])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("hash", kind="stable")
    pair = np.frombuffer(b"".join(pdf["hash"]), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    part = build_shard(pair[:, 0], pair[:, 1], pdf["n"].to_numpy(np.int64), pdf["largest"].to_numpy(np.int64))
    row = {k: v.tobytes() for k, v in part.items()}
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], **row, "bytes": sum(map(len, row.values()))}])


_SHARD_SCHEMA = "shard bigint, pilots binary, fingerprints binary, counts binary, largest binary, bytes bigint"


def build_index(docs: DataFrame, scratch: Scratch, min_chars: int = 40, min_docs: int = 5) -> tuple[int, DataFrame]:
    """The number of shards, and a written table with one row per shard."""
    hashed = docs.select("doc_id", "text").mapInArrow(lambda it: _hashes(it, min_chars), "hash binary, doc_id bigint")
    counted = hashed.distinct().groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))
    frequent = scratch.save(counted.where(F.col("n") >= min_docs))
    n_shards = max(1, -(-frequent.count() // SHARD_KEYS))
    top = F.conv(F.hex(F.substring("hash", 1, 4)), 16, 10).cast("long")
    sharded = frequent.withColumn("shard", F.floor(top * n_shards / F.lit(1 << 32)).cast("long"))
    return n_shards, scratch.save(sharded.groupBy("shard").applyInPandas(_build, _SHARD_SCHEMA))


def _load(n_shards: int, rows: list) -> Index:
    kinds = {"pilots": np.uint32, "fingerprints": np.uint64, "counts": np.int64, "largest": np.int64}
    return Index(n_shards, {r["shard"]: {k: np.frombuffer(r[k], dtype=d) for k, d in kinds.items()} for r in rows})


def _doc_hits(index: Index, doc_ids: list, texts: list[str], min_chars: int) -> Iterator[tuple[list[str], list[bool]]]:
    """The lines of each document, and which of them go."""
    parts = [t.split("\n") for t in texts]
    digests, at = [], []
    for d, lines in enumerate(parts):
        for i, line in enumerate(lines):
            if (key := line_key(line, min_chars)) is not None:
                digests.append(key_hash(key))
                at.append((d, i))
    counts, largest = index.probe(b"".join(digests))
    gone = [[False] * len(lines) for lines in parts]
    for (d, i), n, last in zip(at, counts.tolist(), largest.tolist(), strict=True):
        if n and (NULL_ID if doc_ids[d] is None else doc_ids[d]) != last:
            gone[d][i] = True
    return zip(parts, gone, strict=True)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_lines, n_dropped."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "linededup")
    n_shards, shards = build_index(docs, scratch, min_chars, min_docs)
    sizes = shards.select("shard", "bytes").orderBy("shard").collect()  # one small row per shard
    rows = docs.select("doc_id", "text")
    schema = "doc_id bigint, text string, n_lines bigint, n_dropped bigint"
    if sum(r["bytes"] for r in sizes) > block_bytes:
        return _probe_where_they_are(rows, shards, n_shards, scratch, min_chars).select(*[f.split()[0] for f in schema.split(", ")])
    held = spark.sparkContext.broadcast(shards.collect())  # at most block_bytes

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _load(n_shards, held.value)
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for lines, gone in _doc_hits(index, ids, [t or "" for t in batch.column(1).to_pylist()], min_chars):
                kept.append("\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
                n_lines.append(len(lines))
                n_dropped.append(sum(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    return rows.mapInArrow(clean, schema)


_PROBES = "shard bigint, hash binary, doc_id bigint, key string, line bigint"


def _probes(n_shards: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, ids, keys, places = [], [], [], []
            for doc_id, text, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for i, line in enumerate((text or "").split("\n")):
                    if (k := line_key(line, min_chars)) is not None:
                        digests.append(key_hash(k))
                        ids.append(doc_id)
                        keys.append(key)
                        places.append(i)
            high = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)[:, 0]
            columns = [pa.array(Index.shard_of(high, n_shards)), pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "hash", "doc_id", "key", "line"])

    return run


def _probe_where_they_are(rows: DataFrame, shards: DataFrame, n_shards: int, scratch: Scratch, min_chars: int, part_probes: int = PART_PROBES) -> DataFrame:
    """For an index beyond a broadcast: the probes are dealt to the shards and parts of them."""
    keyed = rows.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    probes = scratch.save(keyed.mapInArrow(_probes(n_shards, min_chars), _PROBES))
    parts = scratch.save(probes.groupBy("shard").agg(F.ceil(F.count("*") / part_probes).cast("int").alias("parts")))
    dealt = probes.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "line"), F.col("parts")).cast("int"))
    arrays = shards.join(parts.select("shard", F.sequence(F.lit(0), F.col("parts") - 1).alias("every")), "shard").withColumn("part", F.explode("every"))

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        index = _load(n_shards, held.to_pylist()[:1])
        asked = asked.combine_chunks()
        counts, largest = index.probe(b"".join(asked.column("hash").to_pylist()))
        own = asked.column("doc_id").fill_null(NULL_ID).to_numpy()
        return asked.select(["doc_id", "key", "line"]).filter(pa.array((counts > 0) & (largest != own)))

    hits = scratch.save(
        dealt.groupBy("shard", "part").cogroup(arrays.groupBy("shard", "part")).applyInArrow(probe, "doc_id bigint, key string, line bigint")
    )
    # The same row may stand in the table more than once; its hits are the same, so they are gathered as a set.
    gone = hits.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("line").alias("gone"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select(
        "doc_id",
        F.array_join(
            F.transform(
                F.filter(
                    F.arrays_zip(lines.alias("l"), F.sequence(F.lit(0), F.size(lines) - 1).alias("i")),
                    lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), x["i"].cast("long")),
                ),
                lambda x: x["l"],
            ),
            "\n",
        ).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns from dedup_lines()."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]], min_chars: int = 40, min_docs: int = 5) -> dict[tuple, tuple]:
    """By doc_id and text: lines, dropped lines and digest of what stays; for tests."""
    holders: dict[bytes, list] = {}
    for doc_id, text in docs:
        for k in {line_key(line, min_chars) for line in (text or "").split("\n")} - {None}:
            holders.setdefault(k, set()).add(NULL_ID if doc_id is None else doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := line_key(x, min_chars)) is None or len(holders[k]) < min_docs or max(holders[k]) == (NULL_ID if doc_id is None else doc_id)]
        out[doc_id, text] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
