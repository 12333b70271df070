"""The pipeline against what each stage does by itself and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontaminate, neardup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    text = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(500)) for _ in range(n))
    items = [(i, text(25)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        body = text(60)
        if i % 5 == 0:
            body += " you scummy idiot"
        if i % 17 == 1:
            body += " " + items[i % 5][1]
        docs.append((i, body, "en", f"src{i % 3}", len(body)))
        if i % 3:
            labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[i][1], "en", "src0", 0) for i in range(1, 60)] + [(2000, None, None, None, None)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_stages(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = {r[0]: r[1] or "" for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    safe = stages["toxicity"](spark, docs, d).cache()
    assert safe.columns == docs.columns and ids(safe) == sorted(i for i, t in text.items() if "scummy" not in t)
    once = stages["near_dedup"](spark, safe, d).cache()
    least: dict = {}
    for i in ids(safe):
        least.setdefault(text[i], i)
    assert ids(once) == sorted(least.values())
    clean = stages["decontamination"](spark, once, d).cache()
    kept = ids(once)
    leaks = {kept[a] for a, _ in decontaminate.brute_force([text[i] for i in kept], [t for _, t in items])}
    assert leaks and ids(clean) == [i for i in kept if i not in leaks]
    mixed = stages["mixing"](spark, clean, d).cache()
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean))
    placed = stages["sharding"](spark, mixed, d).collect()
    assert len(placed) == mixed.count()
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, d).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in placed)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, d, docs, labels=(), items=()):
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named as the operators' own."""
    rnd = random.Random(23)
    text = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(500)) for _ in range(n))
    item, same = text(25), text(60)
    rows = [(i, text(50), "en", f"src{i % 2}", 1) for i in range(20)]
    rows += [(1, text(50), None, None, None), (None, text(50), None, "src0", None), (None, text(50), None, None, None), (None, None, None, None, None), (30, "", "en", "src1", 0)]
    rows += [(40, same, "en", "src0", 1)] * 3 + [(41, same, "en", "src0", 1), (None, same, "en", "src0", 1), (42, text(9000), "en", "src1", 1), (43, text(20) + " " + item, "en", "src1", 1)]
    clashing = ("key", "node", "copy", "shard", "slot", "size", "score", "label", "component", "class_id", "m_doc", "M_Node", "m_source", "m_u", "at")
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])
    d = write(spark, str(tmp_path / "sf"), docs, [(None, None, None), (1, None, 1), (2, 1, None)], [(None, None), (1, item), (2, "")])
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns[5:] == list(clashing), name
        assert docs.where(" OR ".join(f"{c} <> {i}" for i, c in enumerate(clashing))).isEmpty(), name
        kept.append(sorted(map(str, ((r.doc_id, r.text) for r in docs.collect()))))
    assert len(kept[0]) == len(rows)  # too few labels to reject any
    texts = {t or "" for _, t, *_ in rows}
    assert len(kept[1]) == len(texts) and str((40, same)) in kept[1] and str((41, same)) not in kept[1]
    assert kept[2] == [x for x in kept[1] if item not in x] and set(kept[3]) <= set(kept[2])
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert sorted(str(r.doc_id) for r in placed) == sorted(str(r.doc_id) for r in docs.collect())
    assert {r.shard for r in placed} <= set(range(40))


def test_empty_tables(spark, tmp_path):
    d = write(spark, str(tmp_path / "sf"), spark.createDataFrame([], DOCS))
    got = corpus_pipeline.run(spark, d)
    assert got.count() == 0 and "shard" in got.columns


def test_threshold_is_the_stated_one():
    assert neardup.THRESHOLD == 0.8 and decontaminate.THRESHOLD == 0.8
