"""BM25 by a scan or from stored postings. Tokens: lower case, accents folded, runs of letters and digits; no stems, no stop words.

Rows of one id are one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.store import Table

K1, B = 1.2, 0.75
# Accented letters and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def _split(text: Column) -> Column:
    """Tokens, with empty ones where the text begins or ends without any."""
    return F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO), r"[^\p{L}\p{N}]+")


def _exploded(docs: DataFrame, id_column: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, token) of all tokens, empty ones too, so that no document is lost."""
    split = F.array(*[F.struct(F.lit(i).alias("field"), _split(F.col(f)).alias("ts")) for i, f in enumerate(fields)])
    return docs.select(F.col(id_column).alias("id"), F.explode(split).alias("x")).select("id", "x.field", F.explode("x.ts").alias("token"))


def query_tokens(query: str) -> list[str]:
    """The query's distinct tokens, by the same rules."""
    import re

    folded = query.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return sorted({t for t in re.split(r"[\W_]+", folded) if t})


def bm25(docs: DataFrame, query: str, k: int, id_column: str = "doc_id", fields: tuple[str, ...] = ("text",), scope: Column | None = None) -> DataFrame:
    """(id, score) of the best k, by score and id. Scores of several fields are added. An empty query or k = 0 gives none.

    Tokens are counted within their task, so only a row of numbers per document is shuffled; the statistics are one
    aggregate over these rows.
    """
    rows = docs if scope is None else docs.where(scope)
    terms = query_tokens(query)
    if not terms or k <= 0:
        return rows.select(F.col(id_column).alias("id"), F.lit(0.0).alias("score")).limit(0)
    cells = [(f, i) for f in range(len(fields)) for i in range(len(terms))]
    counted = _exploded(rows, id_column, fields).groupBy("id").agg(
        *[F.count_if((F.col("field") == f) & (F.col("token") != "")).alias(f"len_{f}") for f in range(len(fields))],
        *[F.count_if((F.col("field") == f) & (F.col("token") == terms[i])).alias(f"tf_{f}_{i}") for f, i in cells],
    )
    stats = counted.agg(
        F.count("*").alias("n"),
        *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in range(len(fields))],
        *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f, i in cells],
    )
    parts = [F.when(F.col(f"tf_{f}_{i}") > 0, _part(F.col("n"), F.col(f"df_{f}_{i}"), F.col(f"tf_{f}_{i}"), F.col(f"len_{f}"), F.col(f"avg_{f}"))).otherwise(0.0) for f, i in cells]
    hit = F.greatest(*[F.col(f"tf_{f}_{i}") for f, i in cells], F.lit(0)) > 0
    # The statistics are one row.
    scored = counted.where(hit).crossJoin(F.broadcast(stats)).select("id", F.round(reduce(lambda x, y: x + y, parts), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def _part(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    """What one token of a query adds to a document's score."""
    tf = tf.cast("double")
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class TextIndex:
    """Stored postings (field, token, id, tf, len) in folders by a hash of the token, and one row of statistics per field.

    A search reads the folders of the query's tokens only, and within them by the sorted token.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...]):
        self.fields = fields
        self.postings, self.statistics = Table(spark, f"{path.rstrip('/')}/postings", partition="bucket"), Table(spark, f"{path.rstrip('/')}/statistics")

    def build(self, docs: DataFrame, id_column: str) -> None:
        split = F.array(*[F.struct(F.lit(f).alias("field"), F.array_remove(_split(F.col(f)), "").alias("ts")) for f in self.fields])
        fielded = docs.select(F.col(id_column).alias("id"), F.explode(split).alias("x")).select("id", "x.field", F.size("x.ts").cast("long").alias("len"), "x.ts")
        counted = fielded.select("id", "field", "len", F.explode("ts").alias("token")).groupBy("field", "token", "id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
        placed = counted.withColumn("bucket", self._bucket(F.col("token")))
        self.postings.overwrite(placed.repartition("bucket").sortWithinPartitions("token", "field", "id"))
        self.statistics.overwrite(fielded.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean")))

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.BUCKETS)).cast("int")

    def exists(self) -> bool:
        return self.postings.exists() and self.statistics.exists()

    def drop(self) -> None:
        self.postings.drop()
        self.statistics.drop()

    def search(self, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """(id, score) of the best k by score and id, of those in ``among`` (id) only; statistics are of all documents."""
        terms, spark = query_tokens(query), self.postings.spark
        stored = self.postings.read()
        if not terms or k <= 0:
            return stored.select("id", F.lit(0.0).alias("score")).limit(0)
        buckets = spark.createDataFrame([(t,) for t in terms], "token string").select(self._bucket(F.col("token")).alias("b")).distinct().collect()
        found = stored.where(F.col("bucket").isin(*[r["b"] for r in buckets]) & F.col("token").isin(*terms)).drop("bucket")
        frequency = found.groupBy("field", "token").agg(F.count("*").alias("df"))
        # One row per field, and one per field and token of the query.
        scored = found.join(F.broadcast(self.statistics.read()), "field").join(F.broadcast(frequency), ["field", "token"])
        summed = scored.select("id", _part(F.col("n"), F.col("df"), F.col("tf"), F.col("len"), F.col("mean")).alias("part")).groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))
        kept = summed if among is None else summed.join(among.select("id"), "id", "left_semi")
        return kept.orderBy(F.desc("score"), "id").limit(k)


def bm25_sql(query: str, k: int, table: str = "documents", id_column: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> str:
    """The same in plain SQL, for checking."""
    terms = query_tokens(query)
    parts = []
    for f in fields:
        for t in terms:
            df = f"(SELECT count(*) FROM f WHERE len(list_filter(t_{f}, lambda x: x = '{t}')) > 0)"
            tf = f"CAST(len(list_filter(t_{f}, lambda x: x = '{t}')) AS DOUBLE)"
            n = "(SELECT count(*) FROM f)"
            parts.append(
                f"CASE WHEN {tf} > 0 THEN ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * {tf} * {K1 + 1} / ({tf} + {K1} * ({1 - B} + {B} * len(t_{f}) / (SELECT avg(len(t_{f})) FROM f))) ELSE 0.0 END"
            )
    lists = ", ".join(
        f"list_filter(regexp_split_to_array(translate(lower(coalesce({f}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t_{f}" for f in fields
    )
    some = " OR ".join(f"len(list_filter(t_{f}, lambda x: x = '{t}')) > 0" for f in fields for t in terms)
    return f"WITH f AS (SELECT {id_column} AS id, {lists} FROM {table}) SELECT id, round({' + '.join(parts)}, 6) AS score FROM f WHERE {some} ORDER BY score DESC, id LIMIT {k}"
