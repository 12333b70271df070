"""Operator 1: mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source s gets a mean repetition rate r_s = w_s * total / size_s, where size_s is what the source holds in UTF-8
bytes, w_s its share of the weights and total the size of the whole mix (by default that of the input). A document's
count is the Poisson quantile with mean r_s at a uniform number hashed from (seed, doc_id): the number of k with
P(X <= k) <= u. A document is exploded into that many copies, and the copies are shuffled globally by a hash of
(seed, doc_id, copy): partitioned by it and sorted by it within each partition.

The sources' table (one row per source) carries the distribution's table, so a document does no more than count the
entries below its u. The table is written and its entries are counted: up to ``MOST_ENTRIES`` it is broadcast, so that
texts do not move for the join; a larger one is joined by the source, where AQE splits a hot source. Only copies' rows
are shuffled, by a key that is new for each copy.

Without ``weights``, a source's weight is its size to the power ``alpha``. Sources without a weight get none (rate 0).
A null source is a source of its own; a null doc_id hashes as the empty string, a null text has size 0. A source
without any bytes keeps rate 1. Repeated rows draw the same count and are each repeated. An empty table gives an empty
result. The columns of the input are returned as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.common import Scratch, unused

ALPHA = 0.5
SEED = 7
#: u has 48 bits.
U_DIGITS = 12
#: Beyond this many standard deviations above the mean no u of 48 bits is reached.
DEVIATIONS, EXTRA = 9, 40
#: Entries (of 8 bytes) of all sources' distribution tables that are broadcast at most.
MOST_ENTRIES = 1 << 20


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) hashed from the seed and the key."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, U_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**U_DIGITS))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, total: int | None, alpha: float) -> DataFrame:
    """One row per source: m_source (nulls as a mark), m_size, m_rate."""
    sizes = docs.groupBy(F.col("source").alias("m_source")).agg(
        F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("m_size")
    )
    if weights is None:
        weight = F.pow(F.col("m_size").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("m_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("m_weight", F.when(F.col("m_size") > 0, weight).otherwise(0.0))
    sums = weighed.agg(F.sum("m_weight").alias("m_weights"), F.sum("m_size").alias("m_total"))
    size = F.lit(float(total)) if total is not None else F.col("m_total").cast("double")
    rate = F.when(F.col("m_size") == 0, 1.0).otherwise(
        F.col("m_weight") / F.when(F.col("m_weights") > 0, F.col("m_weights")) * size / F.col("m_size")
    )
    # One row joins to one row per source.
    return weighed.crossJoin(F.broadcast(sums)).select("m_source", "m_size", F.coalesce(rate, F.lit(0.0)).alias("m_rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Adds m_cdf, the array of P(X <= k) for k = 0, 1, ..."""
    most = (F.col("m_rate") + DEVIATIONS * F.sqrt("m_rate") + EXTRA).cast("int")
    terms = rates.where(F.col("m_rate") > 0).select(
        "m_source", "m_rate", F.explode(F.sequence(F.lit(0), most)).alias("m_k")
    )
    up_to = Window.partitionBy("m_source").orderBy("m_k").rowsBetween(Window.unboundedPreceding, 0)
    log_k = F.sum(F.when(F.col("m_k") > 0, F.log(F.col("m_k").cast("double"))).otherwise(0.0)).over(up_to)
    log_p = F.col("m_k") * F.log("m_rate") - F.col("m_rate") - log_k
    cdf = terms.withColumn("m_p", F.exp(log_p)).withColumn("m_below", F.sum("m_p").over(up_to))
    return cdf.groupBy("m_source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("m_k", "m_below"))), lambda x: x["m_below"]).alias("m_cdf")
    )


def _held(docs: DataFrame) -> dict[str, str]:
    """Under which names replicate() returns columns of the input that are named as its own."""
    return {name: unused(f"input_{name}", docs) for name in ("copy", "n_copies", "shuffle_key") if name in docs.columns}


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, alpha: float = ALPHA, seed: int = SEED, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """The columns of docs and copy, n_copies (long), shuffle_key (32 hex digits), in global random order."""
    for name, held in _held(docs).items():
        docs = docs.withColumnRenamed(name, held)
    tables = Scratch(docs.sparkSession, "mixing").save(poisson_tables(source_rates(docs, weights, total, alpha)))
    entries = tables.agg(F.coalesce(F.sum(F.size("m_cdf") + F.lit(4)), F.lit(0))).first()[0]
    source, cdf, u = (unused(n, docs) for n in ("m_source", "m_cdf", "m_u"))
    tables = tables.select(F.col("m_source").alias(source), F.col("m_cdf").alias(cdf))
    if entries <= most_entries:
        tables = F.broadcast(tables)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = (
        docs.join(tables, F.col("source").eqNullSafe(F.col(source)))
        .withColumn(u, uniform(seed, key))
        .withColumn("n_copies", F.size(F.filter(cdf, lambda p: p <= F.col(u))).cast("long"))
    )
    copies = counted.where(F.col("n_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}s"), key, F.col("copy").cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.select(*docs.columns, "copy", "n_copies", "shuffle_key").repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def mix_stage(docs: DataFrame, **options) -> DataFrame:
    """A pipeline stage: the mix, with the columns of docs."""
    held = _held(docs)
    return replicate(docs, **options).select(*[F.col(held[c]).alias(c) if c in held else c for c in docs.columns])


def quantile(u: float, rate: float) -> int:
    """The count for one u, by adding terms; for tests."""
    k, log_k, below = 0, 0.0, 0.0
    while k <= rate + DEVIATIONS * math.sqrt(rate) + EXTRA:
        log_k += math.log(k) if k else 0.0
        below += math.exp(k * math.log(rate) - rate - log_k)
        if u < below:
            return k
        k += 1
    return k


ORACLE = f"""
WITH sizes AS (
  SELECT source, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS size FROM documents GROUP BY source
), weighed AS (SELECT source, size, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), {ALPHA}) ELSE 0.0 END AS weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE weight / (SELECT sum(weight) FROM weighed) * (SELECT CAST(sum(size) AS DOUBLE) FROM weighed) / size END AS rate
  FROM weighed
), terms AS (
  SELECT source, rate, unnest(range(0, CAST(trunc(rate + {DEVIATIONS} * sqrt(rate) + {EXTRA}) AS BIGINT) + 1)) AS k FROM rates
), logs AS (
  SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(CAST(k AS DOUBLE)) ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k) AS log_k FROM terms
), cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - log_k)) OVER (PARTITION BY source ORDER BY k) AS below FROM logs
), tables AS (SELECT source, list(below ORDER BY k) AS below FROM cdf GROUP BY source),
counted AS (
  SELECT d.*, len(list_filter(t.below, lambda p: p <= CAST(CAST('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, {U_DIGITS}) AS BIGINT) AS DOUBLE) / {float(16**U_DIGITS)})) AS n_copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS BIGINT) AS copy, CAST(n_copies AS BIGINT) AS n_copies,
  md5('{SEED}s|' || CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(range(1, CAST(n_copies AS BIGINT) + 1)) AS copy FROM counted)
"""
