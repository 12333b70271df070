"""Operators against small literal cases."""

import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import changes, chunking, classify, codecs, embed, graph, lexical, quantize, rank, splitter, store, vector
from marlstone.plans import catalog


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_glob_to_like():
    assert [classify.glob_to_like(g) for g in ("src/**", "a?b", "lib/**/*.dart")] == ["src/%", "a_b", "lib/%%.dart"]
    assert classify.glob_to_like("raw_underscore", strict=False) is None
    assert classify.glob_to_like("raw_underscore") == "raw\\_underscore"


def test_true_glob():
    import re

    match = lambda g, p: bool(re.match(classify.glob_to_regex(g), p))
    assert match("**/*.rs", "a.rs") and match("**/*.rs", "x/y/a.rs") and not match("*.rs", "x/a.rs")
    assert match("src/{a,b}.ts", "src/b.ts") and match("[!x]y", "ay") and not match("[!x]y", "xy")
    with pytest.raises(ValueError, match="unclosed"):
        classify.glob_to_regex("a[b")


def test_aliases_of_languages_and_kinds():
    assert classify.parse_languages(["rs", "TS", "cobol"]) == ["rust", "typescript"]
    assert classify.parse_kinds(["fn", "type", "?"]) == ["function", "typealias"]


def test_file_types(spark):
    paths = ["src/a.rs", "tests/a.rs", "a.test.ts", "x.yaml", "README", "a.tsv", "spec/x.md", "a.b/c"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(classify.file_type(F.col("p"))).collect()] == [0, 1, 1, 2, 3, 3, 1, 3]


def test_changes_and_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, digest string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "file_path string, digest string")
    found = changes.detect(old, new)
    assert dict(rows(found)) == {"a": "removed", "b": "unchanged", "c": "modified", "d": "added"}
    assert {r[0] for r in changes.to_delete(found).collect()} == {"a", "c", "d"}
    assert changes.must_rebuild(False, 1, 2, 5, 5) and changes.must_rebuild(False, None, 2, 1, 0) and changes.must_rebuild(False, 2, 2, 0, 3)
    assert not changes.must_rebuild(False, 2, 2, 5, 5) and changes.must_rebuild(True, 2, 2, 5, 5)


def test_versioned_table(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    mk = lambda xs: spark.createDataFrame(xs, "k int, v string")
    t.append(mk([(1, "a"), (2, "b")]))
    before = t.read()
    t.append(mk([(3, "c"), (4, "d"), (5, "e")]))
    assert t.read().count() == 5 and before.count() == 2
    version = t.version
    t.append(mk([]))
    assert t.version == version
    t.upsert(mk([(5, "z"), (6, "f")]), "k")
    t.delete(mk([(1, "")]), "k")
    assert sorted(rows(t.read())) == [(2, "b"), (3, "c"), (4, "d"), (5, "z"), (6, "f")]
    t.compact(1)
    assert t.read().count() == 5


def test_checkpoint_of_files(spark):
    files = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "file_path string, n_expected long")
    chunks = spark.createDataFrame([("a",), ("b",)], "file_path string")
    assert sorted(r[0] for r in store.complete_files(files, chunks).collect()) == ["b", "c"]
    assert [r[0] for r in store.chunkless_files(files, chunks).collect()] == ["c"]


def test_recursive_split_cases():
    assert [(p.start, p.end) for p in splitter.split("Linea 1.\nLinea 2.\n\nLinea 3.", 15, 0, 5)] == [(0, 8), (9, 17), (19, 27)]
    assert [p.start_line for p in splitter.split("Chunk1\n\nChunk2", 10, 0, 5)] == [1, 3]
    assert splitter.sizing(100, 512, 8) is None and splitter.sizing(5000, 512, 8) == (4096, 2048)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.,\n", max_size=300), st.integers(0, 20))
def test_split_covers_all_but_separators(text, overlap):
    data, pieces = text.encode(), splitter.split(text, 40, overlap, 20)
    held = np.zeros(len(data), dtype=bool)
    for p in pieces:
        held[p.start : p.end] = True
        assert p.start_line == 1 + data[: p.start].count(b"\n")
    assert not bytes(b for b, h in zip(data, held, strict=True) if not h).decode("utf-8", "ignore").strip(" \n.,")


def plain_groups(parts, total, chunk_size, overlap, min_chunk):
    """The least-cost passages by trying every start and every plan before it."""
    n, gap = len(parts.start), lambda d: sum(512 // j for j in range(1, d + 1))
    rest = lambda x: (total - x) * 512 // overlap if overlap else 0
    level, before = [*parts.level, 0], [*parts.before, 2]
    plans = [(0, [])]
    rests = [rest(0)]
    for i in range(n):
        found = []
        for s in range(i, -1, -1):
            size = parts.end[i] - parts.start[s]
            if size > chunk_size and s < i:
                break
            low, wide = min(parts.level[s + 1 : i + 1], default=10**6), max(parts.inside[s + 1 : i + 1], default=0)
            cost = gap(level[s] - low) + gap(level[i + 1] - low) + 64 * (max(0, wide - before[s]) + max(0, wide - before[i + 1])) + (1_048_576 if size < min_chunk else 0)
            own = (int(parts.start[s]), int(parts.end[i]))
            if size > chunk_size:
                found.append((cost + plans[s][0], [*plans[s][1], own]))
                continue
            if overlap:
                reach = [p for p in range(s, i + 1) if p == s or parts.end[p] <= parts.start[s] + overlap]
                p = min(reach, key=lambda p: (plans[p][0] + rests[p], -p))
                cost += 512 + min(0, rests[p] - rest(parts.start[s]))
            else:
                p, cost = s, cost + 256
            found.append((cost + plans[p][0], [*plans[p][1], own]))
        plans.append(min(found, key=lambda f: f[0]))
        rests.append(rest(parts.end[i]))
    return plans[-1][1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["ab", "é", "c. ", "\n", "\n\n", " ", ", ", "; ", "\r\n", "—", "  x", "long" * 12]), max_size=60), st.integers(0, 20), st.integers(20, 60))
def test_split_is_the_cheapest(parts, overlap, size):
    text = "".join(parts)
    overlap = min(overlap, 15)
    found = splitter.fragments(text, overlap or 15)
    total = len(text.encode())
    assert splitter.grouped(found, total, size, overlap, 15) == plain_groups(found, total, size, overlap, 15)


def test_split_along_syntax():
    source = "".join(f"def name{i}(a, b):\n    \"\"\"First. Second, third; fourth.\"\"\"\n    if a:\n        b = [a, {i}, 'x, y. z']\n\n    return a + b\n\n\n" for i in range(12))
    pieces = splitter.split(source, 260, 0, 100, "python")
    assert [source[p.start :].startswith("def name") for p in pieces] == [True] * len(pieces) and len(pieces) >= 6
    body = "    def inner(self):\n        return [1, 2]\n" * 30  # an indented body, and one that is no Python
    for text in (body, body + "}"):
        got = splitter.split(text, 200, 20, 80, "python")
        assert len(got) > 3 and got[0].start_line == 1 and all(p.end - p.start <= 200 for p in got)
    for n in (1, 2, 40):
        leaves = splitter.fragments(source, n, "python")
        held = "".join(source[a:b] for a, b in zip(leaves.start, leaves.end, strict=True))
        assert re.findall(r"\w", source) == re.findall(r"\w", held)


def test_split_chunks(spark):
    body = "\n".join(f"line {i} of some text." for i in range(400))
    one = spark.createDataFrame([("f", body, 11, 410, 0, 1, 0), ("g", "x", 1, 1, 0, 1, 0)], "file_path string, content string, start_line long, end_line long, sub_chunk_idx long, total_sub_chunks long, chunk_strategy int")
    got = splitter.split_chunks(one, 128, 8).orderBy("file_path", "sub_chunk_idx").collect()
    parts = [r for r in got if r.file_path == "f"]
    assert len(parts) > 1 and parts[0].start_line == 11 and parts[-1].end_line == 410
    assert all(r.total_sub_chunks == len(parts) and r.chunk_strategy == 1 for r in parts) and got[-1].content == "x"


def test_tabular_packing(spark):
    def pack(text, budget):
        df = spark.createDataFrame([("db/users.tsv", text)], "file_path string, content string")
        return [(r.symbol_qualified, r.start_line, r.end_line) for r in chunking.pack_rows(df, budget).orderBy("pack_idx").collect()]

    assert pack("h\ta\n1\tx\n2\ty", 4096) == [("db/users.tsv:rows:2-3", 2, 3)]
    assert len(pack("h\n1234567\n12345\n1234567", 8)) == 3
    assert [p[1] for p in pack("h\nabc\n\nabc", 3)] == [2, 4]
    assert pack("h", 10) == [] and pack("", 10) == []


def test_page_packing(spark):
    def pack(pages, budget):
        df = spark.createDataFrame([("d", i + 1, t, h) for i, (t, h) in enumerate(pages)], "doc string, page int, text string, heading string")
        return [r.symbol_qualified for r in chunking.pack_pages(chunking.assemble_pages(df), budget).orderBy("pack_idx").collect()]

    assert pack([("x" * 60, None), ("more", "Chapter 2")], 100) == ["p.1-1", "Chapter 2 · p.2-2"]
    assert pack([("a", None), (" \n", None), ("b", None)], 1000) == ["p.1-3"]


def test_symbol_chunks_walk_back_to_documentation(spark):
    text = "// licence\n\nuse x;\n\n\n/// One.\n/// Two.\n#[inline]\nfn f() {\n}\n"
    files = spark.createDataFrame([("a.rs", text)], "file_path string, content string")
    s = spark.createDataFrame([(1, "a.rs", 9, 10, "/// One.", "function", "f"), (2, "a.rs", 9, 10, None, "function", "g")], "sym_id long, file string, line int, end_line int, doc string, kind string, qualified string")
    got = {r.sym_id: r for r in chunking.symbol_chunks(s, files).collect()}
    assert got[1].start_line == 6 and got[1].content.startswith("/// One.") and got[2].content == "fn f() {\n}"


def test_fusion(spark):
    leg = lambda ids: spark.createDataFrame([(i, r) for r, i in enumerate(ids)], "id int, rank int")
    assert rows(rank.rrf([leg([1, 2, 3]), leg([3, 4, 5])], 10))[0][0] == 3
    assert [r[0] for r in rows(rank.rrf([leg([10, 20]), leg([])], 10))] == [10, 20]


def test_ordering(spark):
    hits = spark.createDataFrame([(1, 10.0, 1, 0), (2, 9.0, 1, 0), (3, 8.0, 2, 0)], "id int, score double, parent_sym_id int, file_type int")
    assert [round(r.score, 2) for r in rank.diversify(hits).orderBy("id").collect()] == [10.0, 8.96, 8.0]
    mixed = spark.createDataFrame([(1, 1.0, 3), (2, 1.0, 0), (3, 9.0, 1)], "id int, score double, file_type int")
    assert [r.id for r in rank.tier_sort(mixed, 3).collect()] == [2, 1, 3]
    syms = spark.createDataFrame([(1, 5.0, 1), (2, 4.0, chunking.NO_SYMBOL), (3, 3.0, 1), (4, 2.0, chunking.NO_SYMBOL), (5, 1.0, 2)], "id int, score double, sym_id long")
    assert sorted(r.id for r in rank.dedup_symbols(syms).collect()) == [1, 2, 4, 5]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "Naïve café"), (2, "cafe cafe"), (3, None)], "doc_id int, text string")
    assert [r.id for r in lexical.bm25(docs, "CAFÉ", 5).collect()] == [2, 1]
    assert lexical.bm25(docs, "", 5).count() == 0 and lexical.bm25(docs, "cafe", 0).count() == 0


def test_method_choice():
    assert [vector.choose(n, 768, 8 << 30).method for n in (500, 5_000, 50_000)] == ["flat", "usearch", "ivf_hnsw_sq"]
    before = vector.choose(9_900, 768, 8 << 30)
    assert vector.choose(10_100, 768, 8 << 30, previous=before).method == "usearch"
    assert vector.choose(15_000, 768, 8 << 30, previous=before).method == "ivf_hnsw_sq"


def test_quantizer():
    rng = np.random.default_rng(1)
    x = embed.l2(rng.standard_normal((300, 128)))
    q = quantize.Quantizer(128)
    codes = q.encode(x)
    scores = q.score(codes, x[7])
    assert scores.argmax() == 7 and abs(np.corrcoef(scores, x @ x[7])[0, 1]) > 0.9
    assert abs((scores - x @ x[7]).mean()) < 0.02
    assert q.score([b"bad", None], x[7]).tolist() == [0.0, 0.0]


def test_ann_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = [(i, (centres[i % 12] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(600)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>").cache()
    index = vector.IvfIndex.build(df, 12).write(str(tmp_path / "ivf"))
    assert index.nprobes <= 4
    hits = total = 0
    for i in range(0, 600, 60):
        exact = {r.vec_id for r in vector.knn(df, x[i][1], 10).collect()}
        hits += len(exact & {r.vec_id for r in index.search(x[i][1], 10).collect()})
        total += 10
    assert hits / total >= 0.9
    assert re.search(r"PartitionFilters: \[[^\]]*cell", index.search(x[0][1], 10)._jdf.queryExecution().toString()) and vector.IvfIndex.read(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("name", ["ivf_probe_all", "ivf_probe_some", "ivf_sq", "ivf_pq", "lsh_ann", "quant_scan"])
def test_recall_of_the_registered_searches(spark, name):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    e = catalog.table(spark, folder, "embeddings")
    queries = {r.vec_id for r in e.where("vec_id % 20 = 0").collect()}
    exact = {(r.query_id, r.vec_id) for r in vector.knn_batch(e, catalog._queries(spark, folder), 10).collect()}
    found = {(r.query_id, r.vec_id) for r in catalog.QUERIES[name](spark, folder).collect()}
    assert {q for q, _ in exact} == queries and len(found & exact) >= 0.9 * len(exact)


def test_vector_searches_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    ask = lambda df: df.select(F.col("vec_id").alias("query_id"), "embedding")
    for df in (none, few):
        assert vector.ProjectionIndex(df).search_batch(ask(none), 2).count() == 0
        assert vector.knn_batch(df, ask(none), 2).count() == 0
    assert [(r.query_id, r.vec_id, r.score) for r in vector.knn_batch(few, ask(few), 1).orderBy("query_id").collect()] == [(1, 1, 0.0), (2, 2, 1.0), (3, 2, 1.0)]
    assert vector.IvfIndex.build(few, 2).search_batch(ask(few), 3, 2).where("query_id = 2").count() == 3
    assert vector.knn_batch(none, ask(few), 2).count() == 0 and vector.ProjectionIndex(none).search_batch(ask(few), 2).count() == 0


def test_codecs():
    rng = np.random.default_rng(8)
    x = embed.l2(rng.standard_normal((1500, 32)))
    for codec, worst in ((codecs.ScalarCodec(x), 0.01), (codecs.ProductCodec(x, 16), 0.2)):
        codes = codec.encode(x)
        assert codes.dtype == np.uint8 and codes.shape[1] in (32, 16)
        assert ((codec.decode(codes) - x) ** 2).sum(axis=1).mean() < worst
    assert codecs.ProductCodec(x[:3], 4).encode(x).max() <= 2


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Naïve café", "x"), (2, "cafe cafe", None), (3, None, "cafe"), (4, "...", "a b")], "id int, text string, title string")
    index = lexical.TextIndex(spark, str(tmp_path / "text"), ("text", "title"))
    assert not index.exists()
    index.build(docs, "id")
    for query in ("CAFÉ", "naive b", "cafe a cafe", "nothing", ""):
        assert [tuple(r) for r in index.search(query, 5).collect()] == [tuple(r) for r in lexical.bm25(docs, query, 5, "id", ("text", "title")).collect()]
    assert [r.id for r in index.search("cafe", 1, docs.where("id <> 3")).collect()] == [2]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", index.search("cafe", 1)._jdf.queryExecution().toString())
    index.drop()
    assert not index.exists()


def test_table_versions(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    rows = lambda *ids: spark.createDataFrame([(i, f"p{i}") for i in ids], "id int, path string")
    t.overwrite(rows(1, 2))
    t.append(rows(3))
    t.append(rows())
    first = t._pointer()["parts"][0]
    t.delete(rows(3), "path")
    assert sorted(r.id for r in t.read().collect()) == [1, 2] and t._pointer()["parts"][0] == first and t.version == 3
    # A run that broke off before its version was in place leaves the table as it was.
    t._write(rows(9))
    assert sorted(r.id for r in store.Table(spark, t.path).read().collect()) == [1, 2]
    with pytest.raises(RuntimeError):
        t._point([first], 3)
    t.compact()
    assert sorted(r.id for r in t.read().collect()) == [1, 2] and len([x for x in os.listdir(t.path) if x.startswith("part-")]) == 1


def test_embedding(spark):
    df = spark.createDataFrame([("abc def",), ("",), (None,)], "content string")
    got = embed.embed(df, embed.HashingModel(16)).collect()
    assert abs(np.linalg.norm(got[0].embedding) - 1) < 1e-6 and not any(got[1].embedding)
    assert embed.batches_within([3, 3, 9, 1], 2, 6) == [[0, 1], [2], [3]]
    assert embed.clip_bytes("aé", 2) == "a" and embed.chunk_budget(10_000, True) == 8192
    with pytest.raises(Exception, match="NaN"):
        embed.embed(df, lambda t: np.full((len(t), 2), np.nan)).collect()


def test_batches_of_like_length():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 9000, 300).tolist()
    batches = embed.padded_batches(lengths, 4096, 2048)
    assert sorted(i for _, own in batches for i in own) == list(range(300)) and [p for p, _ in batches] == sorted(p for p, _ in batches)
    for padded, own in batches:
        assert len(own) <= max(1, min(64, 4096 // padded)) and all(min(lengths[i], 2048) <= padded for i in own)
    model = embed.HashingModel(16)
    texts = ["word " * n for n in (300, 2, 80, 0, 70)]
    asked = []
    run = embed.bucketed(lambda t: asked.append(len(t)) or model(t), lambda t: len(t.split()), 256)
    assert np.array_equal(run(texts), model(texts)) and len(asked) == 3 and len(run([])) == 0


def test_remote_model():
    calls = []

    def post(texts):
        calls.append(texts)
        if len(calls) in (1, 3):
            raise ConnectionError
        return [[float(t), 1.0] for t in texts]

    model = embed.RemoteModel(post, most_items=2, most_bytes=3, first_wait=0.001, at_once=1)
    assert model(["1", "22", "3", "4444"]).tolist() == [[1, 1], [22, 1], [3, 1], [4444, 1]]
    assert [c for c in calls] == [["1", "22"], ["1", "22"], ["3"], ["3"], ["4444"]]
    never = embed.RemoteModel(lambda t: (_ for _ in ()).throw(TimeoutError()), retries=1, first_wait=0.001)
    with pytest.raises(TimeoutError):
        never(["a"])


def test_model_profiles(spark):
    p = embed.profile("intfloat/e5-base-v2", 512, 400, passage_prefix="")
    assert (p.query_prefix, p.passage_prefix, p.longest, p.pooling) == ("query: ", "", 400, "mean")
    assert embed.profile("BAAI/bge-m3").pooling == "cls" and embed.catalogue(spark).count() == 20


def symbols(spark, data):
    return spark.createDataFrame(
        [(i, k, n, q, f, "rust", ln, ln + 1, None, None) for i, (k, n, q, f, ln) in enumerate(data)],
        "sym_id long, kind string, name string, qualified string, file string, language string, line int, end_line int, doc string, parent long",
    )


def test_aliases_and_resolution(spark):
    s = symbols(spark, [("function", "run", "run", "crates/app/src/a.rs", 1), ("function", "run", "run", "crates/lib-x/src/b.rs", 1), ("function", "helper", "helper", "crates/lib-x/src/b.rs", 5), ("function", "main", "main", "crates/app/src/main.rs", 1)])
    a = graph.aliases(s)
    names = dict(rows(a))
    assert "run" not in names and names["a::run"] == 0 and names["lib_x::b::run"] == 1 and names["helper"] == 2
    edges = spark.createDataFrame([(3, "lib_x::b::run", "call", 1), (1, "run", "call", 2), (1, "self::helper", "call", 3), (1, "crate::b::helper", "call", 4), (0, "nothing", "call", 5), (3, "go", "call", 6)], "from_id long, to_name string, kind string, line int")
    imports = spark.createDataFrame([("crates/app/src/main.rs", "go", "lib_x::b::helper")], "file string, local_name string, source string")
    got = {r.line: (r.to_id, r.to_name) for r in graph.resolve(edges, s, a, imports).collect()}
    assert got == {1: (1, None), 2: (1, None), 3: (2, None), 4: (2, None), 5: (None, "*nothing"), 6: (2, None)}
    assert rows(graph.resolve_name(a, s, "run")) == [("ambiguous", 0), ("ambiguous", 1)]
    assert rows(graph.resolve_name(a, s, "zzz")) == [("none", None)]


def test_traversal(spark):
    e = spark.createDataFrame([(1, 2, "call"), (2, 3, "call"), (1, 3, "call"), (3, 1, "call"), (4, 1, "call")], "from_id long, to_id long, kind string")
    s = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "sym_id long")
    assert {r.node: r.depth for r in graph.tree(e, 1, 3).collect()} == {1: 0, 2: 1, 3: 1}
    assert [r.path for r in graph.call_chains(e, s, 3, 4).collect()] == [[4, 1, 3], [4, 1, 2, 3]]
    assert [r.sym_id for r in graph.entry_points(e, s).collect()] == [4]
    got = {r.sym_id: r.appendix_sym_ids for r in graph.appendix_ids(e, s.where("sym_id <> 2")).collect()}
    assert got == {1: [3], 3: [1], 4: [1, 3]}
    with pytest.raises(Exception, match="call chains"):
        graph.call_chains(e, s, 3, 4, most=1).collect()


def test_byte_prefix(spark):
    texts = ["aé€😀b" * 5, "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for cap in range(0, 24):
        got = [r[0] for r in df.select(T.byte_prefix(F.col("t"), cap)).collect()]
        assert got == [embed.clip_bytes(t, cap) for t in texts]
