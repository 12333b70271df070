"""Operator 7: shards of near-equal bytes by Karmarkar-Karp differencing.

Documents of equal text form one indivisible group. A partial partition is a vector of shard sizes; differencing
takes the two partial partitions of largest spread and adds them in opposite order, until one is left.

Groups of at least 1/LARGE of a fair share (so at most LARGE * n_shards of them) are differenced first and give one
partial partition of the shards. All other groups are dealt by hash into buckets of about ``BUCKET_GROUPS``; every
bucket differences its groups together with its proportional part of that first partition, so each bucket fills what
the large groups left open and the sum over all buckets is level. No task gathers more than a bucket, whatever the
input. A group larger than a fair share stays whole: its shard then exceeds the others, which are level.

Only digests and sizes are shuffled, never texts. Rows find their shard by a join on the group's digest, whose hot
keys AQE can split, and slots are numbered by (shard, block of about ``SLOT_ROWS`` rows) plus the block's offset, so no
shard's rows meet in one task, not even rows that are equal in all columns.

Null texts count as empty and form a group with the empty text; a null doc_id is a row like any other (first in its
block); repeated rows are separate rows of one group; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.llm.common import Scratch, text_or_empty

ROW_OVERHEAD = 16
BUCKET_GROUPS = 4_000
SLOT_ROWS = 2_000
LARGE = 64


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions, given as rows of an (n, k) array.

    Returns the k sums and, for each row, the slot to which each of its k entries goes.
    """
    n, k = vectors.shape
    order = np.argsort(vectors, axis=1, kind="stable")
    sums = np.take_along_axis(vectors, order, axis=1)
    heap = [(-(s[-1] - s[0]), i) for i, s in enumerate(sums.tolist())]
    heapq.heapify(heap)
    store = {i: sums[i] for i in range(n)}
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joint = store.pop(a) + store.pop(b)[::-1]
        perm = np.argsort(joint, kind="stable")
        joint = joint[perm]
        node = n + len(merged)
        merged.append((a, b, perm))
        store[node] = joint
        heapq.heappush(heap, (-(int(joint[-1]) - int(joint[0])), node))
    root = heap[0][1]
    place = {root: np.arange(k)}
    for at in range(len(merged) - 1, -1, -1):
        a, b, perm = merged[at]
        here = np.empty(k, dtype=np.int64)
        here[perm] = place.pop(n + at)
        place[a] = here
        place[b] = here[::-1]
    slots = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        slots[i, order[i]] = place[i]
    return store[root], slots


def _solve_bucket(first: np.ndarray, small_total: int):
    """Differences a bucket's groups with its part of the large groups' partition."""
    k = len(first)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_size", "gkey"], ascending=[False, True], kind="stable")
        sizes = pdf["group_size"].to_numpy().astype(np.int64)
        vectors = np.zeros((len(sizes) + 1, k), dtype=np.int64)
        vectors[0] = np.rint(first * (sizes.sum() / max(small_total, 1))).astype(np.int64)
        vectors[1:, k - 1] = sizes
        slots = difference(vectors)[1]
        shard_at = np.empty(k, dtype=np.int32)
        shard_at[slots[0]] = np.arange(k)
        return pd.DataFrame({"gkey": pdf["gkey"].to_numpy(), "shard": shard_at[slots[1:, k - 1]]})

    return solve


def _solve_large(sizes: list[int], k: int) -> tuple[np.ndarray, list[int]]:
    if not sizes:
        return np.zeros(k, dtype=np.int64), []
    vectors = np.zeros((len(sizes), k), dtype=np.int64)
    vectors[:, k - 1] = sizes
    total, slots = difference(vectors)
    return total, slots[:, k - 1].tolist()


def shard(docs: DataFrame, n_shards: int = 40, bucket_groups: int = BUCKET_GROUPS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = text_or_empty()
    rows = scratch.save(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("gkey"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = scratch.save(rows.groupBy("gkey").agg(F.sum("size").alias("group_size")))
    n_rows, n_groups, total = (
        rows.agg(F.count("*")).first()[0],
        *groups.agg(F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).first(),
    )
    least = max(1, total // (n_shards * LARGE))
    # At most LARGE * n_shards + a few groups can have that size each.
    large = groups.where(F.col("group_size") > least).orderBy(F.desc("group_size"), "gkey").collect()
    first, large_shards = _solve_large([r["group_size"] for r in large], n_shards)
    small = groups.where(F.col("group_size") <= least)
    small_total = total - sum(r["group_size"] for r in large)
    bucket = F.pmod(F.xxhash64("gkey"), F.lit(max(1, -(-n_groups // bucket_groups))))
    placed = (
        small.withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandas(_solve_bucket(first, small_total), "gkey string, shard int")
    )
    if large:
        placed = placed.unionByName(
            spark.createDataFrame(
                [(r["gkey"], s) for r, s in zip(large, large_shards, strict=True)], "gkey string, shard int"
            )
        )
    # The block of a row within its shard: by a hash of the row's number, so that no block is large.
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n_rows // (slot_rows * n_shards)))))
    dealt = scratch.save(rows.join(placed, "gkey").withColumn("block", block))
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "gkey", "row")
    return (
        dealt.withColumn("rn", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("rn") + F.col("offset")).cast("long").alias("slot"),
            F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
            F.col("gkey").alias("group_key"),
        )
    )


def shard_stage(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The last stage of a pipeline: documents with the shard and slot of each."""
    return shard(docs, n_shards)
