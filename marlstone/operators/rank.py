"""Fusion and ordering of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.chunking import NO_SYMBOL
from marlstone.operators.classify import tier

# Fixed values.
RRF_K = 60
PARENT_PENALTY = 0.04
DIGITS = 9


def ranked(leg: DataFrame, id_column: str = "id", score: str = "score") -> DataFrame:
    """(id, rank) with rank 0 for the best. A leg is a top-k of bounded size."""
    return leg.select(F.col(id_column).alias("id"), (F.row_number().over(Window.orderBy(F.desc(score), id_column)) - 1).alias("rank"))


def rrf(legs: list[DataFrame], k: int) -> DataFrame:
    """(id, score): sum over legs (id, rank) of 1 / (60 + rank), the best k; ties by id."""
    all_legs = legs[0].select("id", "rank")
    for leg in legs[1:]:
        all_legs = all_legs.unionByName(leg.select("id", "rank"))
    score = F.round(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))), DIGITS)
    return all_legs.groupBy("id").agg(score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def rerank(fused: DataFrame, boosts: DataFrame) -> DataFrame:
    """(id, score): the fused score plus the boost of (id, boost); without one the candidate stays as it is."""
    return fused.join(boosts, "id", "left").select("id", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), DIGITS).alias("score"))


def dedup_symbols(hits: DataFrame, symbol: str = "sym_id", none: int = NO_SYMBOL) -> DataFrame:
    """The best hit of each symbol; hits without one all stay."""
    w = Window.partitionBy(symbol).orderBy(F.desc("score"), "id")
    return hits.withColumn("m_rn", F.row_number().over(w)).where((F.col("m_rn") == 1) | (F.col(symbol) == none)).drop("m_rn")


def diversify(hits: DataFrame, parent: str = "parent_sym_id", penalty: float = PARENT_PENALTY) -> DataFrame:
    """Each further hit of a parent loses the penalty once more; hits without a parent lose nothing."""
    w = Window.partitionBy(parent).orderBy(F.desc("score"), "id")
    seen = F.when(F.col(parent).isNull(), 0).otherwise(F.row_number().over(w) - 1)
    return hits.withColumn("score", F.round(F.col("score") - penalty * seen, DIGITS))


def tier_sort(hits: DataFrame, limit: int, file_type: str = "file_type") -> DataFrame:
    """Source before config before doc before test, each by score; cut to limit."""
    return hits.orderBy(tier(F.col(file_type)), F.desc("score"), "id").limit(limit)


def drop_overlaps(hits: DataFrame) -> DataFrame:
    """Of hits on the same file and symbol name whose lines meet, the later in order goes. hits: a page with column ``pos``.

    A hit is compared with those kept before it, so the page is folded in order as one array per (file, name).
    """
    real = (F.col("sym_id") != NO_SYMBOL) & F.col("symbol_qualified").isNotNull()
    names = hits.columns
    row = F.struct("pos", *[c for c in names if c != "pos"])
    grouped = hits.where(real).groupBy("file_path", "symbol_qualified").agg(F.array_sort(F.collect_list(row)).alias("g"))
    kept = F.aggregate(
        "g",
        F.slice("g", 1, 0),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["start_line"] <= x["end_line"]) & (x["start_line"] <= y["end_line"])), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    good = grouped.select(F.explode(kept).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in names])
    return hits.where(~real).select(*names).unionByName(good)


def appendix(hits: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` related symbols that are not hits themselves, in order of the hits: one passage each, score 0.

    hits: pos, sym_id, appendix_sym_ids; chunks: sym_id, id, sub_chunk_idx.
    """
    related = hits.select("pos", F.posexplode("appendix_sym_ids").alias("at", "sym_id"))
    new = related.join(hits.select("sym_id"), "sym_id", "left_anti")
    first = new.groupBy("sym_id").agg(F.min(F.struct("pos", "at")).alias("o"))
    one = chunks.groupBy("sym_id").agg(F.min(F.struct("sub_chunk_idx", "id")).alias("c"))
    found = first.join(one, "sym_id").select("sym_id", F.col("c.id").alias("id"), F.col("o.pos").alias("pos"), F.col("o.at").alias("at"))
    return found.orderBy("pos", "at").limit(most).select("sym_id", "id", F.lit(0.0).alias("score"))


def relative_path(path: Column, root: str) -> Column:
    """The path below root; as it is if it is elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
