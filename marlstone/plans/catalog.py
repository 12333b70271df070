"""The engine's queries over the test tables, with SQL that computes the same.

Stand-ins: embeddings are passage vectors (label: parent symbol), documents passage texts, doc_id % 4 file types, source
and lang the path; part's keys, taken modulo their number, a call graph; conversations pages; part's rows table lines.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as text_functions
from marlstone.operators import changes, chunking, classify, embed, graph, lexical, quantize, rank, splitter, store, vector
from marlstone.sources import pdftext
from marlstone.streaming import sync

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

QUERY_TEXT = "The thion of the and with ering"
TERMS = lexical.query_tokens(QUERY_TEXT)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


# --- vector search

_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _queries(spark, d):
    """The query set of the searches: every row whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _batch_sql(where: str = "true") -> str:
    return f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
      FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {where}) WHERE rank <= 10"""


@query(_batch_sql())
def knn_exact(spark, d):
    return vector.knn_batch(table(spark, d, "embeddings"), _queries(spark, d), 10)


@query(_batch_sql("e.vec_id % 4 <> 1 AND e.label IN (1, 2, 3)"))
def knn_scoped(spark, d):
    return vector.knn_batch(table(spark, d, "embeddings").where((F.col("vec_id") % 4 != 1) & F.col("label").isin(1, 2, 3)), _queries(spark, d), 10)


@query(
    f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
      FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 3"""
)
def knn_batch_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vector.knn_batch(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3)


@query(_batch_sql())
def ivf_probe_all(spark, d):
    return vector.IvfIndex.build(table(spark, d, "embeddings"), 16).search_batch(_queries(spark, d), 10, 16)


@query()
def ivf_probe_some(spark, d):
    e = table(spark, d, "embeddings")
    return vector.IvfIndex.build(e, vector.choose(e.count(), 64, 8 << 30).num_partitions).search_batch(_queries(spark, d), 10)


@query()
def ivf_sq(spark, d):
    e = table(spark, d, "embeddings")
    return vector.IvfIndex.build(e, vector.choose(e.count(), 64, 8 << 30).num_partitions, codec="sq").search_batch(_queries(spark, d), 10)


@query()
def ivf_pq(spark, d):
    e = table(spark, d, "embeddings")
    return vector.IvfIndex.build(e, vector.choose(e.count(), 64, 8 << 30).num_partitions, codec="pq").search_batch(_queries(spark, d), 10, refine=8)


@query()
def lsh_ann(spark, d):
    return vector.ProjectionIndex(table(spark, d, "embeddings")).search_batch(_queries(spark, d), 10)


@query()
def quant_scan(spark, d):
    return quantize.scan_batch(quantize.encode(table(spark, d, "embeddings"), 64), _queries(spark, d), 10, 64)


@query(
    """SELECT vec_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: round(x / n, 6)) ELSE v END AS unit FROM (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)"""
)
def embed_normalize(spark, d):
    unit = vector.normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.transform(unit, lambda x: vector.rounded(x)).alias("unit"))


@query(
    """SELECT vec_id, list_transform(m, lambda x: CASE WHEN n > 0 THEN round(x / n, 6) ELSE 0.0 END) AS pooled FROM (
      SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n FROM (
        SELECT vec_id, list_transform(range(1, 9), lambda j: list_sum(list_transform(range(0, vec_id % 8 + 1), lambda i: CAST(embedding[8 * i + j] AS DOUBLE))) / (vec_id % 8 + 1)) AS m FROM embeddings))"""
)
def mean_pool(spark, d):
    # Each vector as eight token vectors, of which the first few are unmasked.
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 8 + 1).alias("held"))
    return embed.pool_rows(e, 8, "embedding").select("vec_id", F.transform("pooled", lambda x: vector.rounded(x)).alias("pooled"))


@query("SELECT item_id, 'query: ' || text AS as_query, 'passage: ' || text AS as_passage FROM benchmark")
def prefix_route(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", embed.with_prefix(F.col("text"), "query", "e5-base").alias("as_query"), embed.with_prefix(F.col("text"), "passage", "e5-base").alias("as_passage"))


_GRID = [(n, dim, mem, gpu) for n in (100, 1023, 1024, 5_000, 9_999, 10_000, 50_000, 6_000_000) for dim in (64, 768) for mem in (1 << 24, 8 << 30) for gpu in (False, True)]


@query(
    "WITH g(n, dim, mem, gpu) AS (VALUES " + ", ".join(f"({n}, {dim}, {mem}, {str(gpu).lower()})" for n, dim, mem, gpu in _GRID) + """)
    SELECT CAST(n AS BIGINT) AS n, CAST(dim AS BIGINT) AS dim, CAST(mem AS BIGINT) AS mem, gpu,
      CASE WHEN n < 1024 THEN 'flat' WHEN gpu AND n < 5000000 THEN 'turboquant' WHEN n < 10000 AND CAST(4 AS BIGINT) * dim * n < mem // 4 THEN 'usearch' ELSE 'ivf_hnsw_sq' END AS method,
      CAST(least(256, greatest(4, floor(sqrt(n) + 0.5))) AS BIGINT) AS num_partitions,
      CAST(greatest(CAST(least(256, greatest(4, floor(sqrt(n) + 0.5))) AS BIGINT) // 10, 4) AS BIGINT) AS nprobes,
      CAST(greatest(dim // 8, 1) AS BIGINT) AS num_sub_vectors FROM g"""
)
def method_choice(spark, d):
    rows = []
    for n, dim, mem, gpu in _GRID:
        p = vector.choose(n, dim, mem, gpu)
        rows.append((n, dim, mem, gpu, p.method, p.num_partitions, p.nprobes, p.num_sub_vectors))
    return spark.createDataFrame(rows, "n bigint, dim bigint, mem bigint, gpu boolean, method string, num_partitions bigint, nprobes bigint, num_sub_vectors bigint")


# --- lexical search and fusion


@query(lexical.bm25_sql(QUERY_TEXT, 20))
def bm25_topk(spark, d):
    return lexical.bm25(table(spark, d, "documents"), QUERY_TEXT, 20)


@query(lexical.bm25_sql(QUERY_TEXT + " src1 src2", 20, fields=("text", "source")))
def bm25_two_field(spark, d):
    return lexical.bm25(table(spark, d, "documents"), QUERY_TEXT + " src1 src2", 20, fields=("text", "source"))


_VEC_LEG = f"SELECT e.vec_id AS id, {_COS} AS score FROM embeddings e, {_Q0} q ORDER BY score DESC, id LIMIT {{k}}"
_RRF = """vec AS ({vec}), lex AS ({lex}),
  legs AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM vec UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 FROM lex),
  fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM legs GROUP BY id ORDER BY score DESC, id LIMIT {k})"""


def _legs(spark, d, k):
    vec = vector.knn(table(spark, d, "embeddings"), query_vector(spark, d), k).withColumnRenamed("vec_id", "id")
    return [rank.ranked(vec), rank.ranked(lexical.bm25(table(spark, d, "documents"), QUERY_TEXT, k))]


@query("WITH " + _RRF.format(vec=_VEC_LEG.format(k=60), lex=lexical.bm25_sql(QUERY_TEXT, 60), k=60) + " SELECT id, score FROM fused")
def rrf_fuse(spark, d):
    return rank.rrf(_legs(spark, d, 60), 60)


def _facts(spark, d):
    """Search columns of each passage."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 4).cast("int").alias("file_type"), F.when(F.col("vec_id") % 5 == 0, F.lit(chunking.NO_SYMBOL)).otherwise(F.col("vec_id") % 97).alias("sym_id"), F.col("label").alias("parent_sym_id")
    )


_FACTS = f"facts AS (SELECT vec_id AS id, CAST(vec_id % 4 AS INTEGER) AS file_type, CASE WHEN vec_id % 5 = 0 THEN {chunking.NO_SYMBOL} ELSE vec_id % 97 END AS sym_id, label AS parent_sym_id FROM embeddings)"
_TIER = "CASE file_type WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 END"
_RERANKED = (
    "boosts AS (SELECT e.vec_id AS id, round(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda z: z[1] * z[2])), 6) AS boost FROM embeddings e, "
    + _Q0
    + " q), reranked AS (SELECT f.id, round(f.score + coalesce(b.boost, 0.0), 9) AS score FROM fused f LEFT JOIN boosts b ON f.id = b.id)"
)


def _boosts(spark, d):
    q = vector.literal(query_vector(spark, d))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vector.rounded(vector.dot(F.col("embedding"), q)).alias("boost"))


@query("WITH " + _RRF.format(vec=_VEC_LEG.format(k=60), lex=lexical.bm25_sql(QUERY_TEXT, 60), k=60) + ", " + _RERANKED + " SELECT id, score FROM reranked")
def rerank_boost(spark, d):
    return rank.rerank(rank.rrf(_legs(spark, d, 60), 60), _boosts(spark, d))


_HYBRID = (
    "WITH " + _RRF.format(vec=_VEC_LEG.format(k=120), lex=lexical.bm25_sql(QUERY_TEXT, 120), k=120) + ", " + _RERANKED + ", " + _FACTS
    + f""", hits AS (SELECT r.id, r.score, f.file_type, f.sym_id, f.parent_sym_id FROM reranked r JOIN facts f ON r.id = f.id),
  deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sym_id ORDER BY score DESC, id) AS rn FROM hits) WHERE rn = 1 OR sym_id = {chunking.NO_SYMBOL}),
  spread AS (SELECT * REPLACE (round(score - 0.04 * CASE WHEN parent_sym_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY parent_sym_id ORDER BY score DESC, id) - 1 END, 9) AS score) FROM deduped)
  SELECT id, score, file_type, CAST(sym_id AS BIGINT) AS sym_id, parent_sym_id FROM spread ORDER BY {_TIER}, score DESC, id LIMIT 10"""
)


@query(_HYBRID)
def hybrid_search(spark, d):
    fetch = vector.over_fetch(10, 1_000)
    hits = rank.rerank(rank.rrf(_legs(spark, d, fetch), fetch), _boosts(spark, d)).join(_facts(spark, d), "id")
    return rank.tier_sort(rank.diversify(rank.dedup_symbols(hits)), 10)


@query(
    "WITH " + _RRF.format(vec=_VEC_LEG.format(k=120), lex=lexical.bm25_sql(QUERY_TEXT, 120), k=120) + ", " + _FACTS
    + f" SELECT r.id, r.score, f.file_type, CAST(f.sym_id AS BIGINT) AS sym_id, f.parent_sym_id FROM fused r JOIN facts f ON r.id = f.id ORDER BY {_TIER}, r.score DESC, r.id LIMIT 10"
)
def hybrid_exhaustive(spark, d):
    fetch = vector.over_fetch(10, 1_000, exhaustive=True)
    return rank.tier_sort(rank.rrf(_legs(spark, d, fetch), fetch).join(_facts(spark, d), "id"), 10)


_SCORED = f"scored AS (SELECT f.*, {_COS} AS score FROM facts f JOIN embeddings e ON e.vec_id = f.id, {_Q0} q)"


def _scored(spark, d):
    q = vector.literal(query_vector(spark, d))
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vector.cosine(F.col("embedding"), q).alias("score"))
    return _facts(spark, d).join(s, "id")


@query(
    f"WITH {_FACTS}, {_SCORED} SELECT id, score, CAST(sym_id AS BIGINT) AS sym_id FROM (SELECT *, row_number() OVER (PARTITION BY sym_id ORDER BY score DESC, id) AS rn FROM scored) WHERE rn = 1 OR sym_id = {chunking.NO_SYMBOL}"
)
def dedup_symbol(spark, d):
    return rank.dedup_symbols(_scored(spark, d)).select("id", "score", "sym_id")


@query(f"WITH {_FACTS}, {_SCORED} SELECT id, round(score - 0.04 * (row_number() OVER (PARTITION BY parent_sym_id ORDER BY score DESC, id) - 1), 9) AS score FROM scored")
def diversify_parent(spark, d):
    return rank.diversify(_scored(spark, d)).select("id", "score")


@query(f"WITH {_FACTS}, {_SCORED} SELECT id, score, file_type FROM scored ORDER BY {_TIER}, score DESC, id LIMIT 25")
def tier_sort(spark, d):
    return rank.tier_sort(_scored(spark, d), 25).select("id", "score", "file_type")


_PAGE = """page AS (SELECT conv_id * 100 + turn AS pos, 'f' || CAST(conv_id % 7 AS VARCHAR) AS file_path, 's' || CAST(conv_id % 3 AS VARCHAR) AS symbol_qualified,
  CASE WHEN turn = 1 THEN 4294967295 ELSE conv_id END AS sym_id, (conv_id * 7) % 50 AS start_line, (conv_id * 7) % 50 + turn * 3 AS end_line FROM conversations)"""


@query(
    f"""WITH RECURSIVE {_PAGE}, named AS (SELECT *, row_number() OVER (PARTITION BY file_path, symbol_qualified ORDER BY pos) AS i FROM page WHERE sym_id <> 4294967295),
    fold AS (SELECT file_path, symbol_qualified, i, [{{'p': pos, 's': start_line, 'e': end_line}}] AS kept FROM named WHERE i = 1
      UNION ALL SELECT n.file_path, n.symbol_qualified, n.i, CASE WHEN len(list_filter(f.kept, lambda y: y.s <= n.end_line AND n.start_line <= y.e)) > 0 THEN f.kept
        ELSE list_append(f.kept, {{'p': n.pos, 's': n.start_line, 'e': n.end_line}}) END
      FROM fold f JOIN named n ON n.file_path = f.file_path AND n.symbol_qualified = f.symbol_qualified AND n.i = f.i + 1),
    last AS (SELECT file_path, symbol_qualified, arg_max(kept, i) AS kept FROM fold GROUP BY ALL),
    good AS (SELECT unnest(kept).p AS pos FROM last)
    SELECT p.* REPLACE (CAST(sym_id AS BIGINT) AS sym_id) FROM page p WHERE sym_id = 4294967295 OR pos IN (SELECT pos FROM good)"""
)
def overlap_dedup(spark, d):
    c = table(spark, d, "conversations")
    page = c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("pos"),
        F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string")).alias("file_path"),
        F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("symbol_qualified"),
        F.when(F.col("turn") == 1, F.lit(chunking.NO_SYMBOL)).otherwise(F.col("conv_id")).alias("sym_id"),
        ((F.col("conv_id") * 7) % 50).alias("start_line"),
        ((F.col("conv_id") * 7) % 50 + F.col("turn") * 3).alias("end_line"),
    )
    return rank.drop_overlaps(page)


# --- incremental indexing

_OLD = "(SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file_path, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 0)"
_NEW = "(SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file_path, sha256(text || CASE WHEN doc_id % 11 = 0 THEN ' edited' ELSE '' END) AS digest FROM documents WHERE doc_id % 7 <> 0)"


def _snapshots(spark, d):
    docs = table(spark, d, "documents").withColumn("file_path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    old = docs.where("doc_id % 10 <> 0").select("file_path", F.sha2("text", 256).alias("digest"))
    new = docs.where("doc_id % 7 <> 0").select("file_path", F.sha2(F.concat("text", F.when(F.col("doc_id") % 11 == 0, " edited").otherwise("")), 256).alias("digest"))
    return old, new


_CHANGE = f"SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' WHEN o.digest = n.digest THEN 'unchanged' ELSE 'modified' END AS change FROM {_OLD} o FULL JOIN {_NEW} n ON o.file_path = n.file_path"


@query(_CHANGE)
def changes_diff(spark, d):
    return changes.detect(*_snapshots(spark, d))


@query(f"SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, CAST(0 AS BIGINT) AS chunks_new, CAST(0 AS BIGINT) AS chunks_total FROM ({_CHANGE})")
def index_stats(spark, d):
    return changes.stats(changes.detect(*_snapshots(spark, d)), 0, 0)


@query(f"SELECT file_path FROM ({_CHANGE}) WHERE change <> 'unchanged'")
def delete_set(spark, d):
    return changes.to_delete(changes.detect(*_snapshots(spark, d))).select("file_path")


@query(f"SELECT file_path FROM ({_CHANGE}) WHERE change IN ('added', 'modified')")
def reindex_set(spark, d):
    return changes.to_index(changes.detect(*_snapshots(spark, d))).select("file_path")


@query(f"SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.digest, o.digest) AS digest FROM {_OLD} o FULL JOIN {_NEW} n ON o.file_path = n.file_path")
def upsert_merge(spark, d):
    return store.upsert(*_snapshots(spark, d), "file_path")


@query(f"SELECT * FROM {_OLD} WHERE file_path NOT IN (SELECT file_path FROM {_NEW})")
def delete_paths(spark, d):
    old, new = _snapshots(spark, d)
    return store.delete(old, new, "file_path")


@query("SELECT doc_id FROM documents")
def append_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marlstone-")
    appended = store.Table(spark, f"{folder.rstrip('/')}/appended-{uuid.uuid4().hex}")
    for part in range(3):
        appended.append(docs.where(F.col("doc_id") % 3 == part))
    return appended.read()


@query("SELECT o_orderkey, n_expected FROM (SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS n_expected, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) WHERE n = n_expected")
def files_checkpoint(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("long").alias("n_expected"))
    return store.complete_files(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), key="o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def zero_chunk_files(spark, d):
    return store.chunkless_files(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT source AS project, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes, count(DISTINCT lang) AS n_languages FROM documents GROUP BY source")
def project_stats(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_bytes"), F.countDistinct("lang").alias("n_languages"))


@query("SELECT DISTINCT lang FROM documents")
def languages_distinct(spark, d):
    return table(spark, d, "documents").select("lang").distinct()


# --- paths

PATHS = (
    "src/main.rs", "src/lib.rs", "tests/a.rs", "src/a_test.go", "web/app.ts", "web/app.min.js", "docs/guide.md", "README", "LICENSE-MIT", "license.txt", "Cargo.toml", "Cargo.lock", "package-lock.json",
    "a/b.tsv", "a/b.psv", "a/b.pdf", "a.b/c", "cfg/x.yaml", "x.env", ".hidden/x.py", "node_modules/y.js", "lib/x.g.dart", "ios/Runner.swift", "e2e/t.js", "a.spec.ts", "test_x.py", "x.t.sol", "icons/a.svg", "notes.txt", "frb_generated.rs", "x.ML", "y.mli",
)


def _paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


_P = "p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PATHS) + "]) AS path), b AS (SELECT path, split_part(path, '/', -1) AS name, regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1) AS ext FROM p)"
_LANG_SQL = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.LANGUAGES.items()) + " END"


@query(
    f"""WITH {_P}, k AS (SELECT *, {_LANG_SQL} AS language, CASE WHEN {_LANG_SQL} IS NOT NULL THEN 'code' WHEN ext IN ('tsv', 'psv', 'pdf') THEN ext ELSE 'text' END AS kind FROM b)
    SELECT path, language, kind, CAST(CASE WHEN list_has_any(string_split(path, '/'), ['test', 'tests', '__tests__', 'spec', 'e2e', 'integration_test'])
        OR regexp_matches(name, '(\\.t\\.sol|_test\\.go|_test\\.rs)$|\\.test\\.|\\.spec\\.|^test_') THEN 1
      WHEN kind = 'code' THEN 0 WHEN kind <> 'text' THEN 3 WHEN split_part(path, '.', -1) IN ('toml', 'yaml', 'yml', 'json', 'ini', 'cfg', 'env') THEN 2 ELSE 3 END AS INTEGER) AS file_type FROM k"""
)
def classify_files(spark, d):
    p = F.col("path")
    return _paths(spark).select("path", classify.language(p).alias("language"), classify.source_kind(p).alias("kind"), classify.file_type(p).alias("file_type"))


@query(
    f"""WITH {_P} SELECT path, (starts_with(name, '.') OR name IN ('Cargo.toml', 'pubspec.yaml', 'package.json', 'foundry.toml') OR name LIKE '%.lock' OR name LIKE '%-lock.%'
      OR upper(regexp_extract(name, '^[^.\\-]*')) = 'LICENSE' OR ext IN ('svg', 'ico', 'woff', 'woff2', 'ttf', 'eot', 'otf') OR regexp_matches(name, '{classify.GENERATED}')) AS ignored FROM b"""
)
def ignore_rules(spark, d):
    return _paths(spark).select("path", classify.is_ignored_basename(F.col("path")).alias("ignored"))


@query(f"WITH {_P} SELECT path FROM p WHERE NOT (contains(path, '/') AND split_part(path, '/', 1) IN ('ios', 'android', 'macos', 'linux', 'windows', 'web', 'rust_builder', 'fastlane'))")
def platform_dirs(spark, d):
    return _paths(spark).where(~classify.is_platform_scaffolding(F.col("path"), True))


@query(f"WITH {_P} SELECT path FROM p WHERE '/' || path LIKE '%/src/%'")
def glob_like(spark, d):
    return _paths(spark).where(classify.scope(path_glob="src/**", include_tests=True, path_column="path"))


@query(f"WITH {_P} SELECT path FROM p WHERE regexp_full_match(path, '(?:.*/)?[^/]*\\.(ts|js)')")
def glob_true(spark, d):
    return _paths(spark).where(F.col("path").rlike(classify.glob_to_regex("**/*.{ts,js}")))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(tests?)($|[^A-Za-z0-9])')")
def test_intent(spark, d):
    return table(spark, d, "documents").where(classify.asks_for_tests(F.col("text"))).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 1 AND lang IN ('en', 'fr')")
def scope_filter(spark, d):
    docs = table(spark, d, "documents").withColumn("file_type", F.col("doc_id") % 4)
    return docs.where(classify.scope(["en", "fr"], language_column="lang")).select("doc_id", "lang")


# --- passages


@query("SELECT CAST(doc_id AS VARCHAR) AS file_path, CAST(1 AS BIGINT) AS start_line, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line, text AS content FROM documents")
def chunk_text_file(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return chunking.text_chunks(files).select("file_path", "start_line", "end_line", "content")


_TSV_ROWS = "SELECT 'part' || CAST(p_partkey // 100 AS VARCHAR) || '.tsv' AS file_path, CAST(row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) + 1 AS BIGINT) AS no, CAST(p_partkey AS VARCHAR) || chr(9) || p_name || chr(9) || p_brand AS line FROM part"


@query(
    f"""WITH RECURSIVE rows AS ({_TSV_ROWS}), fold AS (
      SELECT file_path, no, CAST(0 AS BIGINT) AS pack, strlen(line) AS bytes FROM rows WHERE no = 2
      UNION ALL SELECT r.file_path, r.no, CASE WHEN f.bytes + 1 + strlen(r.line) <= 500 THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.bytes + 1 + strlen(r.line) <= 500 THEN f.bytes + 1 + strlen(r.line) ELSE strlen(r.line) END
      FROM fold f JOIN rows r ON r.file_path = f.file_path AND r.no = f.no + 1)
    SELECT f.file_path, f.pack AS pack_idx, f.file_path || ':rows:' || min(f.no) || '-' || max(f.no) AS symbol_qualified, min(f.no) AS start_line, max(f.no) AS end_line, string_agg(r.line, chr(10) ORDER BY f.no) AS content
    FROM fold f JOIN rows r ON r.file_path = f.file_path AND r.no = f.no GROUP BY f.file_path, f.pack"""
)
def chunk_tabular(spark, d):
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", "p_brand")
    rows = table(spark, d, "part").select(F.concat(F.lit("part"), F.floor(F.col("p_partkey") / 100).cast("string"), F.lit(".tsv")).alias("file_path"), "p_partkey", line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"])
    files = rows.groupBy("file_path").agg(F.concat(F.lit("key\tname\tbrand\n"), F.array_join(ordered, "\n")).alias("content"))
    return chunking.pack_rows(files, 500)


@query(
    """WITH RECURSIVE pages AS (SELECT conv_id AS doc, turn + 1 AS no, CASE WHEN turn % 3 = 2 THEN 'Turn ' || CAST(turn AS VARCHAR) END AS heading, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    fold AS (SELECT doc, i, CAST(0 AS BIGINT) AS pack, strlen(text) AS bytes, strlen(text) >= 900 AS closed FROM pages WHERE i = 1
      UNION ALL SELECT p.doc, p.i, CASE WHEN f.closed OR (p.heading IS NOT NULL AND f.bytes >= 450) THEN f.pack + 1 ELSE f.pack END,
        CASE WHEN f.closed OR (p.heading IS NOT NULL AND f.bytes >= 450) THEN strlen(p.text) ELSE f.bytes + 2 + strlen(p.text) END,
        CASE WHEN f.closed OR (p.heading IS NOT NULL AND f.bytes >= 450) THEN strlen(p.text) ELSE f.bytes + 2 + strlen(p.text) END >= 900
      FROM fold f JOIN pages p ON p.doc = f.doc AND p.i = f.i + 1)
    SELECT f.doc, f.pack AS pack_idx, coalesce(arg_min(coalesce(p.heading, ''), p.no) || CASE WHEN arg_min(coalesce(p.heading, ''), p.no) = '' THEN '' ELSE ' · ' END, '') || 'p.' || min(p.no) || '-' || max(p.no) AS symbol_qualified,
      min(p.no) AS start_line, max(p.no) AS end_line, string_agg(p.text, chr(10) || chr(10) ORDER BY p.no) AS content FROM fold f JOIN pages p ON p.doc = f.doc AND p.i = f.i GROUP BY f.doc, f.pack"""
)
def chunk_pages(spark, d):
    c = table(spark, d, "conversations")
    heading = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Turn "), F.col("turn").cast("string")))
    pages = c.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text", heading.alias("heading"))
    return chunking.pack_pages(chunking.assemble_pages(pages), 900)


@query("SELECT doc_id, strlen(text) AS n_bytes, strlen(text) > 512 * 8 AS is_split FROM documents")
def adaptive_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), splitter.needs_split(F.col("text"), 512, 8).alias("is_split"))


@query()
def recursive_split(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    chunks = chunking.text_chunks(files).select("file_path", "sym_id", "start_line", "end_line", "content", F.lit(0).cast("long").alias("sub_chunk_idx"), F.lit(1).cast("long").alias("total_sub_chunks"), F.lit(0).alias("chunk_strategy"))
    return splitter.split_chunks(chunks, 256, 8)


@query("SELECT doc_id, substr(sha256(source || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || '0' || chr(31) || text), 1, 32) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.lit(0), F.col("text")).alias("chunk_id"))


# --- symbol graph

_N = "(SELECT count(*) FROM part)"
_EDGES = f"edges AS (SELECT p_partkey % {_N} AS from_id, (7 * p_partkey + 3) % {_N} AS to_id, CASE WHEN p_partkey % 5 = 0 THEN 'ref' ELSE 'call' END AS kind FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey % {_N}, (3 * p_partkey + 1) % {_N}, 'call' FROM part WHERE p_partkey % 2 = 0)"
_SYMBOLS = f"symbols AS (SELECT p_partkey % {_N} AS sym_id, split_part(p_name, ' ', 1) AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '::' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) END AS qualified, p_brand || '.py' AS file, p_size AS line, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey // 4) * 4 % {_N} END AS parent, CASE WHEN p_size % 3 = 0 THEN 'class' WHEN p_size % 3 = 1 THEN 'function' ELSE 'const' END AS kind FROM part)"


def _edges(spark, d):
    p = table(spark, d, "part")
    n = p.count()
    k = F.col("p_partkey")
    a = p.where("p_partkey % 3 <> 0").select((k % n).alias("from_id"), ((7 * k + 3) % n).alias("to_id"), F.when(k % 5 == 0, "ref").otherwise("call").alias("kind"))
    return a.unionByName(p.where("p_partkey % 2 = 0").select((k % n).alias("from_id"), ((3 * k + 1) % n).alias("to_id"), F.lit("call").alias("kind")))


def _symbols(spark, d):
    p = table(spark, d, "part")
    n = p.count()
    k = F.col("p_partkey")
    name = F.substring_index("p_name", " ", 1)
    return p.select(
        (k % n).alias("sym_id"), name.alias("name"), F.when(k % 2 == 0, F.concat_ws("::", "p_brand", name)).otherwise(name).alias("qualified"), F.concat("p_brand", F.lit(".py")).alias("file"), F.lit("python").alias("language"),
        F.col("p_size").alias("line"), F.when(k % 4 != 0, (F.floor(k / 4) * 4) % n).alias("parent"), F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("const").alias("kind"),
    )


_ALIASES = """counts AS (SELECT name, count(*) AS c FROM symbols GROUP BY name), given AS (
  SELECT sym_id, qualified AS alias FROM symbols JOIN counts USING (name) WHERE qualified <> name OR c = 1
  UNION ALL SELECT sym_id, file || '::' || name FROM symbols WHERE file <> name
  UNION ALL SELECT sym_id, name FROM symbols JOIN counts USING (name) WHERE c = 1), aliases AS (SELECT alias, min(sym_id) AS sym_id FROM given GROUP BY alias)"""


@query(f"WITH {_SYMBOLS}, {_ALIASES} SELECT alias, sym_id FROM aliases")
def alias_first_writer(spark, d):
    return graph.aliases(_symbols(spark, d))


@query(
    f"""WITH {_SYMBOLS}, {_ALIASES}, {_EDGES}, named AS (SELECT e.from_id, s.name AS to_name, e.kind FROM edges e JOIN symbols s ON s.sym_id = e.to_id),
    r AS (SELECT n.from_id, n.to_name, n.kind, coalesce(a.sym_id, (SELECT min(l.sym_id) FROM symbols l WHERE l.file = f.file AND l.name = n.to_name)) AS to_id
      FROM named n JOIN symbols f ON f.sym_id = n.from_id LEFT JOIN aliases a ON a.alias = n.to_name)
    SELECT from_id, to_id, CASE WHEN to_id IS NULL THEN '*' || to_name END AS to_name, CASE WHEN to_id IS NULL THEN 'external' ELSE 'resolved' END AS state, kind FROM r"""
)
def edge_resolve(spark, d):
    s = _symbols(spark, d)
    named = _edges(spark, d).join(s.select(F.col("sym_id").alias("to_id"), F.col("name").alias("to_name")), "to_id").select("from_id", "to_name", "kind", F.lit(1).alias("line"))
    imports = spark.createDataFrame([], "file string, local_name string, source string")
    return graph.resolve(named, s, graph.aliases(s), imports).drop("line")


@query(f"WITH {_EDGES} SELECT to_id AS sym_id, from_id AS caller_id, kind FROM edges")
def reverse_edges(spark, d):
    return graph.reverse(_edges(spark, d).withColumn("line", F.lit(1))).drop("line")


_REACH2 = """calls AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'call' AND to_id IN (SELECT sym_id FROM own) AND from_id IN (SELECT sym_id FROM own)),
  d1 AS (SELECT from_id AS s, to_id AS n FROM calls WHERE to_id <> from_id), d2 AS (SELECT DISTINCT d1.s, c.to_id AS n FROM d1 JOIN calls c ON c.from_id = d1.n WHERE c.to_id <> d1.s AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.s = d1.s AND x.n = c.to_id)),
  near AS (SELECT s, n, 1 AS depth FROM d1 UNION ALL SELECT s, n, 2 FROM d2)"""


@query(
    f"""WITH {_EDGES}, own AS (SELECT DISTINCT from_id AS sym_id FROM edges WHERE from_id % 4 <> 3), {_REACH2}
    SELECT s AS sym_id, list(n ORDER BY depth, n) AS appendix_sym_ids FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY depth, n) AS rn FROM near) WHERE rn <= 32 GROUP BY s"""
)
def bfs_appendix(spark, d):
    e = _edges(spark, d)
    return graph.appendix_ids(e, e.where("from_id % 4 <> 3").select(F.col("from_id").alias("sym_id")))


_TREE = """WITH RECURSIVE {edges}, t AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS depth UNION SELECT {to}, t.depth + 1 FROM t JOIN edges e ON {at} = t.node WHERE t.depth < 3),
  first AS (SELECT node, min(depth) AS depth FROM t GROUP BY node)
  SELECT f.node, CASE WHEN f.depth = 0 THEN NULL ELSE (SELECT min(p.node) FROM first p JOIN edges e ON {at} = p.node WHERE {to} = f.node AND p.depth = f.depth - 1) END AS parent, f.depth FROM first f"""


@query(_TREE.format(edges=_EDGES, to="e.from_id", at="e.to_id"))
def callers_tree(spark, d):
    return graph.tree(_edges(spark, d), 5, 3, callers=True)


@query(_TREE.format(edges=_EDGES, to="e.to_id", at="e.from_id"))
def callees_tree(spark, d):
    return graph.tree(_edges(spark, d), 5, 3)


_ENTRIES = "entries AS (SELECT sym_id FROM symbols WHERE sym_id NOT IN (SELECT to_id FROM edges WHERE kind = 'call'))"


@query(
    f"""WITH RECURSIVE {_EDGES}, {_SYMBOLS}, {_ENTRIES}, calls AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'call'),
    paths AS (SELECT [CAST(5 AS BIGINT)] AS path UNION ALL SELECT list_prepend(c.from_id, p.path) FROM paths p JOIN calls c ON c.to_id = p.path[1] WHERE NOT list_contains(p.path, c.from_id) AND len(p.path) <= 4)
    SELECT path, CAST(len(path) AS INTEGER) AS n FROM paths WHERE path[1] IN (SELECT sym_id FROM entries)"""
)
def call_chains(spark, d):
    return graph.call_chains(_edges(spark, d), _symbols(spark, d), 5, 4)


@query(f"WITH {_EDGES}, {_SYMBOLS}, {_ENTRIES} SELECT sym_id FROM entries")
def entry_points(spark, d):
    return graph.entry_points(_edges(spark, d), _symbols(spark, d)).select("sym_id")


@query(f"WITH {_SYMBOLS} SELECT parent, list(sym_id ORDER BY line, sym_id) AS child_ids FROM symbols WHERE parent IS NOT NULL GROUP BY parent")
def children_by_parent(spark, d):
    return graph.children(_symbols(spark, d))


@query(
    f"""WITH RECURSIVE {_SYMBOLS}, up AS (SELECT sym_id, parent FROM symbols WHERE kind = 'class' UNION SELECT s.sym_id, s.parent FROM up JOIN symbols s ON s.sym_id = up.parent)
    SELECT DISTINCT sym_id FROM up WHERE parent IS NULL"""
)
def kind_filter(spark, d):
    return graph.kept_by_kind(_symbols(spark, d), ["class"]).select("sym_id")


@query(
    f"""WITH {_SYMBOLS}, {_ALIASES}, target AS (SELECT min(name) AS name FROM symbols), hit AS (SELECT sym_id FROM aliases, target WHERE alias = name), same AS (SELECT s.sym_id FROM symbols s, target t WHERE s.name = t.name OR s.qualified = t.name),
    ids AS (SELECT DISTINCT sym_id FROM hit UNION SELECT sym_id FROM same WHERE NOT EXISTS (SELECT 1 FROM hit)) SELECT CASE WHEN (SELECT count(*) FROM ids) = 1 THEN 'found' ELSE 'ambiguous' END AS match, sym_id FROM ids"""
)
def resolve_name(spark, d):
    s = _symbols(spark, d)
    return graph.resolve_name(graph.aliases(s), s, s.agg(F.min("name")).first()[0])


@query(
    f"""WITH {_SYMBOLS}, {_ALIASES}, ranked AS (SELECT a.sym_id, a.alias, CASE WHEN a.alias = s.qualified AND contains(a.alias, '::') THEN 0 WHEN split_part(a.alias, '::', -1) = s.name AND len(string_split(a.alias, '::')) = 2 THEN 1
      WHEN split_part(a.alias, '::', -1) = s.name AND contains(a.alias, '::') AND NOT starts_with(a.alias, 'crates::') AND NOT contains(a.alias, '-') THEN 2 ELSE 3 END AS rule
      FROM aliases a JOIN symbols s ON s.sym_id = a.sym_id JOIN counts c ON c.name = s.name WHERE c.c = 1 OR contains(a.alias, '::'))
    SELECT sym_id, alias, CAST(rank AS INTEGER) AS rank FROM (SELECT sym_id, alias, row_number() OVER (PARTITION BY sym_id ORDER BY rule, alias) AS rank FROM ranked) WHERE rank <= 3"""
)
def alias_candidates(spark, d):
    s = _symbols(spark, d)
    return graph.candidate_aliases(s, graph.aliases(s))


@query(
    """WITH s AS (SELECT doc_id AS sym_id, doc_id AS file, CAST(1 AS INTEGER) AS line, CAST(2 AS INTEGER) AS end_line FROM documents WHERE doc_id % 2 = 0), asked AS (SELECT doc_id AS sym_id FROM documents)
    SELECT a.sym_id, s.sym_id IS NOT NULL AS ok, CASE WHEN s.sym_id IS NOT NULL THEN array_to_string(string_split(d.text, chr(10))[1:2], chr(10)) END AS body, CASE WHEN s.sym_id IS NULL THEN 'unknown symbol #' || CAST(a.sym_id AS VARCHAR) END AS error
    FROM asked a LEFT JOIN s ON s.sym_id = a.sym_id LEFT JOIN documents d ON d.doc_id = s.file"""
)
def symbol_bodies(spark, d):
    docs = table(spark, d, "documents")
    s = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("sym_id"), F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(2).alias("end_line"))
    return graph.bodies(docs.select(F.col("doc_id").alias("sym_id")), s, docs.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content")))


@query(
    f"""WITH {_EDGES}, hits AS (SELECT p_partkey % {_N} AS sym_id, p_partkey AS pos FROM part WHERE p_partkey < 20), own AS (SELECT DISTINCT from_id AS sym_id FROM edges), {_REACH2},
    ids AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY depth, n) - 1 AS at FROM near), o AS (SELECT i.n AS sym_id, min(ROW(h.pos, i.at)) AS o FROM hits h JOIN ids i ON i.s = h.sym_id WHERE i.at < 32 AND i.n NOT IN (SELECT sym_id FROM hits) GROUP BY i.n)
    SELECT sym_id, sym_id * 10 AS id, CAST(0.0 AS DOUBLE) AS score FROM o ORDER BY o LIMIT 3"""
)
def appendix_related(spark, d):
    e = _edges(spark, d)
    n = table(spark, d, "part").count()
    hits = table(spark, d, "part").where("p_partkey < 20").select((F.col("p_partkey") % n).alias("sym_id"), F.col("p_partkey").alias("pos"))
    own = e.select(F.col("from_id").alias("sym_id")).distinct()
    ids = graph.appendix_ids(e, own)
    chunks = table(spark, d, "part").select((F.col("p_partkey") % n).alias("sym_id"), ((F.col("p_partkey") % n) * 10).alias("id"), F.lit(0).alias("sub_chunk_idx"))
    return rank.appendix(hits.join(ids, "sym_id", "left"), chunks)


# --- events, headings, scalars


@query(
    """WITH e AS (SELECT user_id AS project, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT project, ts, sum(new) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
    SELECT project, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY project, i"""
)
def debounce_sessions(spark, d):
    return sync.debounce(table(spark, d, "events"), project="user_id", quiet="1 hour")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click'")
def dirty_projects(spark, d):
    return sync.dirty_projects(table(spark, d, "events"), "user_id", F.col("event_type") == "click")


_RUNS = "runs AS (SELECT conv_id, turn, text, round(CASE WHEN turn % 5 = 0 THEN 14.04 WHEN turn % 2 = 0 THEN 10.01 ELSE 10.03 END, 1) AS size FROM conversations)"
_MODE = "mode AS (SELECT conv_id, size AS body FROM (SELECT conv_id, size, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, size) AS rn FROM runs GROUP BY conv_id, size) WHERE rn = 1)"


def _measured(spark, d):
    size = F.when(F.col("turn") % 5 == 0, 14.04).when(F.col("turn") % 2 == 0, 10.01).otherwise(10.03).cast("double")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text", F.round(size, 1).alias("size"))))
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["text"].alias("text"), x["size"].alias("size"))).alias("lines"))
    return pdftext.measure(pages, "conv_id")


@query(f"WITH {_RUNS}, {_MODE} SELECT conv_id, CAST(body AS DOUBLE) AS body FROM mode")
def font_mode(spark, d):
    return _measured(spark, d).select("conv_id", "body")


@query(
    f"""WITH {_RUNS}, {_MODE} SELECT r.conv_id, arg_min(r.text, r.turn) AS heading FROM runs r JOIN mode m ON m.conv_id = r.conv_id
    WHERE r.size >= 1.2 * m.body AND strlen(r.text) <= 120 AND CAST(length(regexp_replace(r.text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS DOUBLE) / strlen(r.text) >= 0.5 GROUP BY r.conv_id"""
)
def heading_pick(spark, d):
    return _measured(spark, d).where("heading IS NOT NULL").select("conv_id", "heading")


@query(
    "SELECT doc_id, CASE WHEN strlen(text) <= 101 THEN text ELSE list_reduce(list_prepend('', list_transform(range(1, 102), lambda i: text[i:i])), lambda a, c: CASE WHEN strlen(a) + strlen(c) <= 101 THEN a || c ELSE a || repeat(' ', 0) END) END AS short FROM documents WHERE false"
    " UNION ALL SELECT doc_id, substr(text, 1, CAST((SELECT max(i) FROM range(0, 102) r(i) WHERE strlen(substr(text, 1, i)) <= 101) AS BIGINT)) FROM documents"
)
def byte_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text_functions.byte_prefix(F.col("text"), 101).alias("short"))


_SIGNATURES = [("rust", "pub async fn run(x: u8) -> u8 {", "run(x: u8) -> u8"), ("typescript", "export default function go(a) {", "go(a)"), ("python", "async def f(x):", "f(x):"), ("go", "func Add(a int) int {", "Add(a int) int"), ("solidity", "function f() public;", "f() public"), ("dart", "static final x;", "x"), ("ocaml", "let rec loop n", "loop n"), ("rust", "  ", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _SIGNATURES) + ") t(language, signature, short)")
def signature_shorten(spark, d):
    df = spark.createDataFrame([(a, b) for a, b, _ in _SIGNATURES], "language string, signature string")
    return df.select("language", "signature", text_functions.short_signature(F.col("signature"), F.col("language")).alias("short"))


@query(
    "SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM (SELECT event_id, event_id * 37 AS s FROM events)"
)
def elapsed_format(spark, d):
    return table(spark, d, "events").select("event_id", text_functions.elapsed(F.col("event_id") * 37).alias("ago"))
