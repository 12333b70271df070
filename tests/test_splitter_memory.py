"""The splitter hands on passages as it goes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from marlstone.operators import splitter


def test_a_task_holds_few_passages(spark, monkeypatch):
    """A batch of 40 MB is not held as texts, passages and output at once."""
    held = []
    df = spark.createDataFrame([("f", 1, 1, "x" * 9000, 0, 1, 0)], "file_path string, start_line long, end_line long, content string, sub_chunk_idx long, total_sub_chunks long, chunk_strategy int")
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *args: held.append(f) or real(self, f, *args))
    splitter.split_chunks(df, 256, 8)
    monkeypatch.setattr(splitter, "split", lambda text, size, *_: [splitter.Piece(a, min(a + size, len(text)), 1, 1) for a in range(0, len(text), size)])
    texts = [f"{i:05} " + "y" * (20_000 + i) for i in range(1900)] + ["z" * (3 << 20), None]
    ones = pa.array(np.ones(len(texts), np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), ones, ones, pa.array(texts), ones, ones, ones], df.columns)
    batch = batch.slice(0, len(texts) - 1)  # the filter before lets no null through
    tracemalloc.start()
    try:
        seen = [(b.nbytes, b.column("file_path").to_pylist(), ["".join(p["content"] for p in row) for row in b.column("m_pieces").to_pylist()][-1:]) for b in held[0](iter([batch]))]
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()
    assert [i for _, ids, _ in seen for i in ids] == batch.column("file_path").to_pylist()
    assert all(n < 2 << 20 for n, _, _ in seen[:-1]) and seen[-1][2] == [texts[-2]]
    assert all(last == [texts[int(ids[-1])]] for _, ids, last in seen)


def test_slices_of_a_batch():
    for sizes in ([], [0, 0], [5, None, 1 << 20, 3, (1 << 20) + 1, 0], [1 << 19] * 5):
        batch = pa.RecordBatch.from_arrays([pa.array([None if n is None else "a" * n for n in sizes], pa.string())], ["content"])
        parts = list(splitter._parts(batch, batch.column(0)))
        assert [len(x or "") for p in parts for x in p.column(0).to_pylist()] == [n or 0 for n in sizes]
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= splitter._TEXT for p in parts)
