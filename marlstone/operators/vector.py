"""Vector search: exact cosine top-k, an inverted-file index, random-projection hashing, method and parameter choice."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import codecs
from marlstone.operators.store import Table

#: Scores are rounded so that ties do not depend on the order of additions.
DIGITS = 6


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rounded(a: Column, digits: int = DIGITS) -> Column:
    """As SQL's round() of a double: the product is rounded, halves away from zero, and a zero keeps its sign."""
    scale = F.lit(float(10**digits))
    nearest = lambda x: F.when(F.round(x * scale) == 0, x * 0.0).otherwise(F.round(x * scale) / scale)
    return F.transform(F.array(a), nearest)[0]  # so that a is worked out once


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, rounded; 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, rounded(dot(a, b) / length)).otherwise(0.0)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(_double(a), lambda x: x / length)).otherwise(_double(a))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(table: DataFrame, query: list[float], k: int, scope: Column | None = None, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows of largest cosine with the query among those in scope, by score and id. Only id and vector are read to rank."""
    rows = table if scope is None else table.where(scope)
    scored = rows.select(id_column, cosine(F.col(embedding), literal(query)).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


#: Scores that a task holds at a time, and rows of a batch that are taken at once.
TILE, TILE_ROWS = 1 << 19, 2048
_NONE = np.finfo(np.float64).min


def _rounded(x: np.ndarray) -> np.ndarray:
    """As rounded()."""
    scaled = x * 10.0**DIGITS
    whole = np.trunc(scaled)
    return (whole + np.copysign(np.abs(scaled - whole) >= 0.5, scaled)) / 10.0**DIGITS


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices, short ones first, so that few scores are judged before there is something to be better than."""
    at, size = 0, 64
    while at < batch.num_rows:
        yield batch.slice(at, size)
        at, size = at + size, min(2 * size, TILE_ROWS)


def _blocks(n: int, rows: int) -> Iterator[slice]:
    """n queries in slices whose scores of so many rows are no more than a tile."""
    size = max(1, TILE // max(rows, 1))
    return (slice(at, at + size) for at in range(0, n, size))


class _Best:
    """The k best rows of each of n queries so far, by rounded score and id. Scores below ``least`` do not count any more."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, _NONE)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, queries: slice | np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores (queries, rows) of some queries and of the rows with these ids; -inf or NaN for pairs that do not count."""
        least = self.least[queries].copy()
        new = np.flatnonzero(least == _NONE)
        if len(new) and len(ids) > self.k:
            there = scores[new]
            there[np.isnan(there)] = -np.inf
            least[new] = np.maximum(np.partition(there, -self.k, axis=1)[:, -self.k] - 2 * 10.0**-DIGITS, _NONE)
        at, row = np.nonzero(scores >= least[:, None])
        number = (np.arange(queries.start, queries.start + len(scores)) if isinstance(queries, slice) else queries)[at]
        score, found = _rounded(scores[at, row]), ids[row]
        last = self.score[number, -1]
        better = (score > last) | (score == last) & (found < self.ids[number, -1])
        self.waiting.append((number[better], score[better], found[better]))
        self.held += int(better.sum())
        if self.held > min(TILE // 2, self.score.size // 2):
            self.merge()

    def merge(self) -> None:
        if not self.held:
            self.waiting = []
            return
        number, score, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        touched = np.unique(number)
        number = np.concatenate([number, np.repeat(touched, self.k)])
        score, ids = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, -score, number))
        first = np.searchsorted(number[order], touched)
        kept = order[first[:, None] + np.arange(self.k)]  # each has k at least, those of before
        self.score[touched], self.ids[touched] = score[kept], ids[kept]
        full = np.isfinite(self.score[touched, -1])
        self.least[touched[full]] = self.score[touched[full], -1] - 2 * 10.0**-DIGITS
        self.waiting, self.held = [], 0


def _topk_blocks(ids: np.ndarray, score, k: int):
    """The k best rows of each query within a task.

    score gives, from a batch and the least scores that count, tiles (queries, row ids, scores) of at most ``TILE`` scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)
        for batch in batches:
            for tile in score(batch, best.least):
                best.offer(*tile)
            best.merge()
        real = np.isfinite(best.score.ravel())
        columns = [pa.array(x.ravel()[real]) for x in (np.repeat(ids, k), best.ids, best.score)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return run


def batched(rows: DataFrame, queries: DataFrame, k: int, make_score, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best rows of every query (query_id, embedding).

    Queries are taken in blocks of bounded size; each task scores its rows for a block in tiles and keeps k of each query,
    so only tasks * queries * k rows are shuffled. Vectors must be of one width; make_score turns a block's vectors into
    a function as in _topk_blocks(), of batches whose first column is the id.
    """
    out = None
    n = max(1, -(-queries.count() // block))
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        held = part.select("query_id", "embedding").collect()
        if not held:
            continue
        q = np.array([r["embedding"] for r in held], dtype=np.float64)
        ids = np.array([r["query_id"] for r in held], dtype=np.int64)
        near = rows.mapInArrow(_topk_blocks(ids, make_score(q), k), "query_id bigint, vec_id bigint, score double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rescored(near: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): of the candidates (query_id, vec_id) the k best of each query by exact cosine."""
    exact = (
        near.join(rows.select("vec_id", F.col("embedding").alias("m_row")), "vec_id")
        .join(queries.select("query_id", F.col("embedding").alias("m_query")), "query_id")
        .select("query_id", "vec_id", cosine(F.col("m_row"), F.col("m_query")).alias("score"))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cosines(queries: np.ndarray):
    unit = _unit(queries)

    def score(batch: pa.RecordBatch, least: np.ndarray):
        for part in _parts(batch):
            rows, ids = _unit(_matrix(part.column(1), part.num_rows)), part.column(0).to_numpy()
            for q in _blocks(len(unit), len(rows)):
                yield q, ids, unit[q] @ rows.T

    return score


def knn_batch(table: DataFrame, queries: DataFrame, k: int, block: int = 4096, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest rows of every query, by exact cosine."""
    return batched(table.select(F.col(id_column).cast("long"), embedding), queries, k, _cosines, block)


def _sampled(table: DataFrame, rows: int, seed: int, id_column: str, embedding: str) -> np.ndarray:
    """Unit vectors of a bounded sample, the same on every run."""
    by = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))
    picked = table.select(id_column, embedding).orderBy(by, id_column).limit(rows).collect()
    return _unit(np.array([r[1] for r in picked], dtype=np.float64)) if picked else np.empty((0, 0))


def _neighbours(sample: np.ndarray, k: int, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sample's vectors, and the numbers of the k nearest in the sample of each."""
    queries = sample[:n_queries]
    scores = queries @ sample.T
    return queries, np.argsort(-scores, axis=1, kind="stable")[:, :k]


class IvfIndex:
    """Cells around seeded centroids. Centroids are fitted on a bounded sample, every row is assigned to its nearest cell.

    ``nprobes`` is the least number of cells by which ``recall`` of the k nearest rows are found within the sample. With a
    codec the rows of a cell are ranked by their codes first, without reading their vectors, and ``refine`` times as many
    as asked for by their vectors then.
    """

    def __init__(self, centroids: np.ndarray, assigned: DataFrame, nprobes: int, codec=None):
        self.centroids, self.assigned, self.nprobes, self.codec = centroids, assigned, nprobes, codec

    @staticmethod
    def build(table: DataFrame, n_cells: int, sample_rows: int = 20_000, rounds: int = 10, seed: int = 42, id_column: str = "vec_id", embedding: str = "embedding", recall: float = 0.97, k: int = 10, tune_queries: int = 500, codec: str | None = None) -> IvfIndex:
        """codec is None, "sq" (a byte per coordinate) or "pq" (a byte per eight coordinates)."""
        x = _sampled(table, sample_rows, seed, id_column, embedding)
        rng = np.random.default_rng(seed)
        centroids = x[rng.choice(len(x), min(n_cells, len(x)), replace=False)]
        for _ in range(rounds):
            nearest = (x @ centroids.T).argmax(axis=1)
            for c in range(len(centroids)):
                members = x[nearest == c]
                if len(members):
                    centroids[c] = members.mean(axis=0)
            centroids = _unit(centroids) if len(x) else centroids
        fixed = centroids.copy()
        nprobes = max(1, len(fixed))
        if len(x):
            queries, near = _neighbours(x, k, tune_queries)
            order = np.argsort(np.argsort(-(queries @ fixed.T), axis=1, kind="stable"), axis=1)  # by query the place of each cell
            place = np.take_along_axis(order, (x @ fixed.T).argmax(axis=1)[near], axis=1)
            found = np.cumsum(np.bincount(place.ravel(), minlength=len(fixed))) / place.size
            nprobes = int(np.argmax(found >= recall)) + 1

        coder = None
        if codec and len(x):
            coder = codecs.ScalarCodec(x) if codec == "sq" else codecs.ProductCodec(x, max(x.shape[1] // 8, 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = [c.tobytes() for c in coder.encode(_unit(_matrix(batch.column(1), batch.num_rows)))] if coder and batch.num_rows else [None] * batch.num_rows
                cell = (_matrix(batch.column(1), batch.num_rows) @ fixed.T).argmax(axis=1).astype(np.int32) if batch.num_rows else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(code, pa.binary())], [*batch.schema.names, "cell", "code"])

        rows = table.select(F.col(id_column).alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding"))
        schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, embedding array<float>, cell int, code binary"
        return IvfIndex(fixed, rows.mapInArrow(assign, schema), nprobes, coder)

    def write(self, path: str) -> IvfIndex:
        """The stored index: rows in folders by cell, so that a probe reads its cells alone, and the centroids."""
        spark = self.assigned.sparkSession
        cells, centroids = IvfIndex._tables(spark, path)
        cells.overwrite(self.assigned.repartition("cell"))
        rows = [(i, self.nprobes, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        centroids.overwrite(spark.createDataFrame(rows, "cell int, nprobes int, centroid array<double>"))
        return IvfIndex(self.centroids, cells.read(), self.nprobes, self.codec)

    @staticmethod
    def _tables(spark: SparkSession, path: str) -> tuple[Table, Table]:
        return Table(spark, f"{path.rstrip('/')}/cells", partition="cell"), Table(spark, f"{path.rstrip('/')}/centroids")

    @staticmethod
    def read(spark: SparkSession, path: str) -> IvfIndex | None:
        cells, centroids = IvfIndex._tables(spark, path)
        if not (cells.exists() and centroids.exists()):
            return None
        rows = centroids.read().orderBy("cell").collect()  # one per cell
        return IvfIndex(np.array([r["centroid"] for r in rows]), cells.read(), rows[0]["nprobes"])

    @staticmethod
    def drop(spark: SparkSession, path: str) -> None:
        for t in IvfIndex._tables(spark, path):
            t.drop()

    def probed(self, queries: np.ndarray, nprobes: int) -> np.ndarray:
        """(queries, nprobes): the nearest cells of each."""
        return np.argsort(-(_unit(queries) @ self.centroids.T), axis=1, kind="stable")[:, :nprobes]

    def search(self, query: list[float], k: int, nprobes: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """Top k among the rows of the nearest cells (of those in ``among``, by vec_id), scored exactly."""
        cells = self.probed(np.array([query], dtype=np.float64), nprobes or self.nprobes)[0].tolist()
        rows = self.assigned.where(F.col("cell").isin(cells))
        return knn(rows if among is None else rows.join(among.select("vec_id"), "vec_id", "left_semi"), query, k)

    def search_batch(self, queries: DataFrame, k: int, nprobes: int | None = None, block: int = 4096, refine: int = 4) -> DataFrame:
        """(query_id, vec_id, score, rank) of the k nearest rows of every query within its cells, scored exactly."""
        decode = self.codec.decode if self.codec is not None else None

        def make_score(q: np.ndarray):
            unit, near = _unit(q), self.probed(q, nprobes or self.nprobes)
            wanted = np.zeros((len(q), len(self.centroids)), dtype=bool)
            np.put_along_axis(wanted, near, True, axis=1)
            asking = [np.flatnonzero(w) for w in wanted.T]

            def score(batch: pa.RecordBatch, least: np.ndarray):
                ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                order = np.argsort(cell, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                    for part in _parts(batch.take(pa.array(own))):
                        if decode is None:
                            rows = _unit(_matrix(part.column(1), part.num_rows))
                        else:
                            rows = _unit(decode(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)))
                        for q in _blocks(len(asking[cell[own[0]]]), len(rows)):
                            some = asking[cell[own[0]]][q]
                            yield some, part.column(0).to_numpy(), unit[some] @ rows.T

            return score

        rows = self.assigned.select(F.col("vec_id").cast("long"), "embedding" if decode is None else "code", F.col("cell").cast("int"))
        if decode is None:
            return batched(rows, queries, k, make_score, block)
        near = batched(rows, queries, refine * k, make_score, block).select("query_id", "vec_id")
        return rescored(near, self.assigned.select(F.col("vec_id").cast("long"), "embedding"), queries, k)


def _code(rows: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return ((rows @ planes > 0) << np.arange(planes.shape[1])).sum(axis=1)


class ProjectionIndex:
    """Random-projection hashing: of ``tables`` hashes, each of the signs of ``bits`` projections, a row must share one with the query.

    Without ``tables`` their number is set on a bounded sample: the least by which ``recall`` of the k nearest are found.
    """

    def __init__(self, table: DataFrame, bits: int = 8, tables: int | None = None, seed: int = 42, id_column: str = "vec_id", embedding: str = "embedding", recall: float = 0.97, k: int = 10, sample_rows: int = 20_000, most_tables: int = 1024):
        self.rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
        self.bits, self.seed = bits, seed
        x = _sampled(table, sample_rows, seed, id_column, embedding)
        self.tables = tables or 1
        if tables is None and len(x):
            queries, near = _neighbours(x, k, 200)
            hit = np.zeros(near.shape, dtype=bool)
            for t in range(most_tables):
                planes = self._planes(t, x.shape[1])
                own, others = _code(queries, planes), _code(x, planes)
                hit |= others[near] == own[:, None]
                self.tables = t + 1
                if hit.mean() >= recall:
                    break

    def _planes(self, table: int, width: int) -> np.ndarray:
        return np.random.default_rng((self.seed, table)).standard_normal((width, self.bits))

    def search_batch(self, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
        """(query_id, vec_id, score, rank) of the k nearest rows of every query among those that share a code with it."""

        def make_score(q: np.ndarray):
            unit = _unit(q)
            planes = [self._planes(t, q.shape[1]) for t in range(self.tables)]
            small = np.min_scalar_type((1 << self.bits) - 1)
            codes = np.stack([_code(q, p).astype(small) for p in planes], axis=1)

            def score(batch: pa.RecordBatch, least: np.ndarray):
                for part in _parts(batch):
                    rows, ids = _unit(_matrix(part.column(1), part.num_rows)), part.column(0).to_numpy()
                    own = np.stack([_code(rows, p).astype(small) for p in planes], axis=1)
                    for q in _blocks(len(unit), len(rows)):
                        scores, asked = unit[q] @ rows.T, codes[q]
                        at, row = np.nonzero(scores >= least[q, None])
                        step = max(1, TILE * 8 // len(planes))
                        for lo in range(0, len(at), step):
                            x, y = at[lo : lo + step], row[lo : lo + step]
                            other = ~(asked[x] == own[y]).any(axis=1)
                            scores[x[other], y[other]] = -np.inf
                        yield q, ids, scores

            return score

        return batched(self.rows, queries, k, make_score, block)


# Sizes at which the search method changes.
FLAT_BELOW, GPU_BELOW, GRAPH_BELOW = 1_024, 5_000_000, 10_000
KEEP_WITHIN = 25  # per cent


@dataclass(frozen=True)
class SearchParams:
    method: str
    indexed_chunks: int
    num_partitions: int
    nprobes: int
    num_sub_vectors: int
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    refine_factor: int = 2


def choose_method(n: int, dim: int, memory_bytes: int, gpu: bool) -> str:
    if n < FLAT_BELOW:
        return "flat"
    if gpu and n < GPU_BELOW:
        return "turboquant"
    if n < GRAPH_BELOW and 4 * dim * n < memory_bytes // 4:
        return "usearch"
    return "ivf_hnsw_sq"


def choose(n: int, dim: int, memory_bytes: int, gpu: bool = False, previous: SearchParams | None = None) -> SearchParams:
    """Method and parameters; the previous method stays while n is within 25 % of what it was chosen for."""
    method = choose_method(n, dim, memory_bytes, gpu)
    if previous is not None:
        slack = previous.indexed_chunks * KEEP_WITHIN // 100
        if max(0, previous.indexed_chunks - slack) <= n <= previous.indexed_chunks + slack:
            method = previous.method
    parts = min(256, max(4, math.floor(math.sqrt(n) + 0.5)))
    return SearchParams(method, n, parts, max(parts // 10, 4), max(dim // 8, 1))


def over_fetch(limit: int, n: int, exhaustive: bool = False) -> int:
    """How many candidates either leg fetches."""
    return limit * (12 if exhaustive or n <= 20_000 else 8 if n <= 100_000 else 6)


#: Reference points for choosing by hand; editorial, not measured. accuracy, speed, build, compression.
METHODS = {"flat": (100, 30, 100, 0), "ivf_hnsw_sq": (82, 95, 60, 80), "turboquant": (40, 99, 100, 100)}
