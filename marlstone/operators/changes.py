"""Change detection between two snapshots of a tree, and what an index run has to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect(old: DataFrame, new: DataFrame, key: str = "file_path", digest: str = "digest") -> DataFrame:
    """(key, change) with change one of added, modified, removed, unchanged."""
    o = old.select(F.col(key), F.col(digest).alias("old_digest"))
    n = new.select(F.col(key), F.col(digest).alias("new_digest"))
    change = (
        F.when(F.col("old_digest").isNull(), "added")
        .when(F.col("new_digest").isNull(), "removed")
        .when(F.col("old_digest") == F.col("new_digest"), "unchanged")
        .otherwise("modified")
    )
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def to_index(changes: DataFrame, force: bool = False) -> DataFrame:
    """Paths to chunk again: added and modified ones, with force the unchanged ones too."""
    return changes.where(F.col("change").isin(*(["added", "modified"] + ["unchanged"] * force)))


def to_delete(changes: DataFrame, force: bool = False) -> DataFrame:
    """Paths whose rows go before new ones are written; added ones are among them, so that a resumed run adds no rows twice."""
    return changes.where(F.col("change").isin(*(["removed", "added", "modified"] + ["unchanged"] * force)))


def must_rebuild(refresh: bool, index_version: int | None, current_version: int, n_chunks: int, n_files: int) -> bool:
    """Whether everything is indexed again: on request, for an old index, and for chunks without project or files without chunks."""
    if refresh:
        return True
    if index_version is None:
        return n_chunks > 0 or n_files > 0
    return index_version != current_version or (n_files > 0 and n_chunks == 0)


def stats(changes: DataFrame, n_chunks_new: int, n_chunks_total: int) -> DataFrame:
    """One row: numbers of paths by change, new and all chunks."""
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return changes.agg(*[count(c) for c in ("added", "modified", "removed", "unchanged")]).select(
        "*", F.lit(n_chunks_new).cast("long").alias("chunks_new"), F.lit(n_chunks_total).cast("long").alias("chunks_total")
    )
