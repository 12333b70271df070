"""Bounded samples of labelled documents for fitting, and the contract's split by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, by the modulus; null ids have none."""
    return F.pmod(F.crc32(column.cast("string")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, excluded: int, limit: int) -> DataFrame:
    """doc_id, text, label of at most ``limit`` labelled ids outside the held-out remainder.

    The ids are those of least md5, so the sample is the same on every run; texts are fetched by a broadcast of these
    bounded ids. Ids labelled more than once take the larger label; null ids and labels are left out.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(remainder(F.col("doc_id"), modulus) != excluded)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
