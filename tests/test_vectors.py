"""Vector searches and their numbers: rounding as in SQL, memory that does not grow with the queries."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import vector
from marlstone.plans import catalog


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, -1e-8, 1e-8]), (1, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.unit for r in catalog.QUERIES["embed_normalize"](spark, str(tmp_path)).collect()}
    assert got == {0: [1.0, 0.0, 0.0], 1: [0.0, 0.0, 0.0]}
    assert [math.copysign(1, x) for x in got[0]] == [1, -1, 1]
    values = [0.0078125, -0.0078125, -0.0, 1.0000005, math.nan, math.inf, None]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(vector.rounded(F.col("x")))
    assert [repr(r[0]) for r in df.collect()] == ["0.007813", "-0.007813", "-0.0", "1.000001", "nan", "inf", "None"]


SEARCHES = ["ivf_probe_all", "ivf_sq", "ivf_pq", "knn_batch_topk", "ivf_probe_some", "lsh_ann", "knn_exact", "quant_scan", "knn_scoped"]


@pytest.mark.parametrize("name", SEARCHES)
def test_a_task_holds_few_scores(spark, tmp_path, monkeypatch, name):
    """Of a block of queries and a batch of rows as large as they get; all scores at once would be 328 MB."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    held, batched = [], vector.batched

    def kept(rows, queries, k, make_score, *args):
        held.append((rows, k, make_score))
        return batched(rows, queries, k, make_score, *args)

    monkeypatch.setattr(vector, "batched", kept)
    catalog.QUERIES[name](spark, str(tmp_path))
    rows, k, make_score = held[0]
    part = rows.toArrow()
    batch = pa.concat_tables([part] * (10_000 // part.num_rows)).combine_chunks().to_batches()[0]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), *batch.columns[1:]], batch.schema.names)
    run = vector._topk_blocks(np.arange(4096), make_score(rng.standard_normal((4096, 64))), k)
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in run(iter([batch])))
        assert found > 0 and tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()


def test_best_rows_in_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    for k, rows, most in ((1, 40, 7), (5, 300, 64), (8, 5, 1000), (4, 500, 5000)):
        monkeypatch.setattr(vector, "TILE", most)
        scores, ids = np.round(rng.uniform(-0.1, 0.1, (23, rows)), 2) + rng.uniform(-3e-7, 3e-7, (23, rows)), rng.permutation(rows)
        scores[rng.random(scores.shape) < 0.2] = -np.inf
        scores[rng.random(scores.shape) < 0.05] = np.nan
        scores[3] = -np.inf
        best = vector._Best(23, k)
        for at in range(0, rows, 37):
            for q in (slice(0, 9), np.arange(22, 8, -1)):
                best.offer(q, ids[at : at + 37], scores[q, at : at + 37].copy())
        best.merge()
        for q in range(23):
            want = sorted((-float(vector._rounded(s)), i) for s, i in zip(scores[q], ids.tolist(), strict=True) if np.isfinite(s))[:k]
            assert [(-s, i) for s, i in zip(best.score[q].tolist(), best.ids[q].tolist(), strict=True) if np.isfinite(s)] == want


def test_searches_over_many_batches_and_blocks(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(np.column_stack([np.ones(150), rng.integers(-2, 3, (150, 7))]), 4, axis=0)  # copies, and equal scores of others
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    ask = df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    length = np.linalg.norm(x, axis=1)
    cosine = vector._rounded(x @ x.T / np.outer(length, length))
    want = {(q, i, float(cosine[q, i])) for q in range(0, 600, 9) for i in np.lexsort((np.arange(600), -cosine[q]))[:6].tolist()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        index = vector.IvfIndex.build(df, 9)
        for found in (vector.knn_batch(df, ask, 6, block=20), index.search_batch(ask, 6, 9, block=20), vector.ProjectionIndex(df, 1, 60).search_batch(ask, 6, block=20)):
            got = {(r.query_id, r.vec_id, r.score) for r in found.collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
