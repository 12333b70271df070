"""The engine over a small tree, its sources, rendering and streaming."""

import pytest
from pyspark.sql import functions as F

from marlstone import render
from marlstone.session import ENDS, PHASES, Engine
from marlstone.sources import extract, pdftext, tree
from marlstone.streaming import sync

RUST = """use crate::util::helper;
/// Adds numbers.
pub fn add(a: i32) -> i32 {
    helper(a)
}
pub struct Counter { x: i32 }
impl Counter {
    pub fn bump(&self) -> i32 { add(self.x) }
}
"""
UTIL = "pub fn helper(a: i32) -> i32 {\n    a + 1\n}\n"
PDF = b"%PDF-1.4\n1 0 obj\n<< /Length 10 >>\nstream\nBT /F1 20 Tf 50 700 Td (Algorithm C) Tj /F1 10 Tf 0 -40 Td (Body text) Tj 60 0 Td (more) Tj 0 -12 Td <4142> Tj ET\nendstream\nendobj\n"


@pytest.fixture
def project(tmp_path):
    files = {
        "src/a.rs": RUST, "src/util.rs": UTIL, "README.md": "# Title\n\nCounting things with counters\n", "data/users.tsv": "id\tname\n1\tann\n2\tbob\n", "tests/t.rs": "fn check() { add(1); }\n",
        "node_modules/x.js": "function no() {}", "Cargo.toml": '[package]\nname = "demo"\n', ".gitignore": "skip.md\nbuild/\n", "skip.md": "ignored", "build/x.md": "ignored", "pkg/__init__.py": "def under():\n    return 1\n",
    }
    root = tmp_path / "demo"
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.bin").write_bytes(b"\xff\xfe\x00")
    (root / "paper.pdf").write_bytes(PDF)
    return root


def test_walk(spark, project):
    got = {r.file_path: (r.language, r.file_type) for r in tree.walk(spark, str(project)).collect()}
    assert set(got) == {"src/a.rs", "src/util.rs", "README.md", "data/users.tsv", "tests/t.rs", "pkg/__init__.py", "paper.pdf"}
    assert got["src/a.rs"] == ("rust", 0) and got["tests/t.rs"][1] == 1 and got["data/users.tsv"] == ("tsv", 3)
    assert [r.file_path for r in tree.preamble(tree.walk(spark, str(project), keep_manifests=True)).collect()] == ["Cargo.toml"]


def test_dependency_root(spark, tmp_path):
    home, root = tmp_path / "home", tmp_path / "app"
    for d in ("home/.cargo/registry/src/x/serde-1.0.1", "home/.cargo/registry/src/x/serde-1.0.9", "home/.cargo/registry/src/x/serde-json-2.0.0", "home/.pub-cache/hosted/pub.dev/args-2.1", "app/node_modules/left"):
        (tmp_path / d).mkdir(parents=True)
    find = lambda p: (found := tree.dependency_root(spark, str(root), p, str(home))) and found.rsplit("/", 1)[-1]
    assert [find(p) for p in ("serde", "left", "args", "none")] == ["serde-1.0.9", "left", "args-2.1", None]
    (root / "Cargo.lock").write_text('[[package]]\nname = "other"\nversion = "3.0.0"\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\n')
    assert find("serde") == "serde-1.0.1"
    assert tree.locked_version("", '{"devDependencies": {"left": "^2.0"}}', "left") == "2.0" and tree.locked_version("", "{", "left") is None


def test_index_in_batches_with_cancel_and_resume(spark, project, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"), model_id="e5-base", batch_files=3)
    root, said = str(project), iter(["run", "pause", "cancel"])
    seen: list[str] = []
    first = engine.index(root, control=lambda: next(said), progress=seen.append)
    assert seen[0] == "scan" and seen[-1] == "cancelled" and set(seen) <= {*PHASES, *ENDS}
    done = engine._table(root, "files").read().count()
    assert first["cancelled"] and 0 < done < 7
    again = engine.index(root)
    assert again["added"] == 7 - done and again["unchanged"] == done and not again["cancelled"]
    assert "add" in [r.symbol_qualified for r in engine.search(root, "add numbers", mode="passage").collect()]
    assert [r.symbol_qualified for r in engine._table(root, "chunks").read().where("language = 'pdf'").collect()] == ["Algorithm C · p.1-1"]
    with pytest.raises(ValueError):
        engine.search(root, "x", mode="other")
    with pytest.raises(ZeroDivisionError):
        (project / "README.md").write_text("changed")
        engine.index(root, control=lambda: 1 // 0, progress=seen.append)
    assert seen[-1] == "failed"


def test_index_search_and_lookup(spark, project, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"))
    root = str(project)
    first = engine.index(root)
    assert first["added"] == 7 and first["chunks_total"] == first["chunks_new"] > 6
    assert engine.index(root)["unchanged"] == 7
    hits = engine.search(root, "add numbers", limit=3).collect()
    assert hits and hits[0].symbol_qualified == "add" and hits[0].file_type == 0
    assert not any(h.file_type == 1 for h in engine.search(root, "check add", limit=10).collect())
    assert any(h.file_type == 1 for h in engine.search(root, "check test", limit=10).collect())
    assert "src/a.rs:2-5" in engine.search_text(root, "add numbers")
    assert "├── " in engine.symbol(root, "add") or "└── helper" in engine.symbol(root, "add")
    assert engine.symbol(root, "missing").startswith("no symbol")
    assert "m#" in engine.project_map(root) and "@ Cargo.toml" in engine.project_map(root)
    assert "[rust] src/a.rs" in engine.file_tree(root)
    assert engine.resolve_project("demo") == root == engine.resolve_project()
    # Changing, adding and removing files gives the same passages as indexing anew.
    (project / "src/util.rs").write_text(UTIL.replace("+ 1", "+ 2"))
    (project / "README.md").unlink()
    (project / "NEW.md").write_text("new text\n")
    counts = engine.index(root)
    assert (counts["added"], counts["modified"], counts["removed"]) == (1, 1, 1)
    shown = lambda e: sorted((r.id, r.file_path, r.content) for r in e._table(root, "chunks").read().collect())
    fresh = Engine(spark, str(tmp_path / "fresh"))
    fresh.index(root)
    assert shown(engine) == shown(fresh)
    assert all(r.ok for r in engine.doctor(root).collect())
    engine.remove(root)
    engine.remove("/nowhere")
    with pytest.raises(LookupError):
        engine.search(root, "x")


def test_extract_languages():
    kinds = lambda lang, text: [(s[1], s[3]) for s in extract.extract("f", text, lang)[0]]
    assert kinds("rust", RUST) == [("function", "add"), ("struct", "Counter"), ("impl", "impl Counter"), ("method", "Counter::bump")]
    assert kinds("typescript", "export class C {\n  run(a: number): void {\n    x(a);\n  }\n}\nconst f = (a) => x(a);\n") == [("class", "C"), ("method", "C::run"), ("function", "f")]
    assert kinds("javascript", "function a() { return b(); }\n") == [("function", "a")]
    assert kinds("go", "package m\nfunc Add(a int) int {\n  return help(a)\n}\ntype T struct { a int }\n") == [("function", "Add"), ("typealias", "T")]
    assert kinds("ocaml", "let rec loop n =\n  add n 1\ntype t = int\n") == [("function", "loop"), ("typealias", "t")]
    assert kinds("solidity", "contract C {\n  event E(uint a);\n  function f() public { g(); }\n}\n")[:2] == [("class", "C"), ("event", "C::E")]
    assert ("class", "W") in kinds("dart", "class W {\n  int go(int a) {\n    return a;\n  }\n}\n")
    assert kinds("python", "X = 1\nclass A:\n  def f(self):\n    y = 2\n    return g()\n") == [("const", "X"), ("class", "A"), ("method", "A::f")]
    assert extract.extract("f.py", "def (", "python") == ([], [], [])
    _, calls, imports = extract.extract("src/a.rs", RUST, "rust")
    assert [c[1] for c in calls] == ["helper", "add"] and imports == [("src/a.rs", "helper", "crate::util::helper")]
    moved = extract.extract("src/a.rs", "\n\n" + RUST, "rust")[0]
    assert [s[0] for s in moved] == [s[0] for s in extract.extract("src/a.rs", RUST, "rust")[0]]


def test_pdf_pages():
    assert pdftext.pages_text(PDF) == [("Algorithm C\nBody text more\nAB", "Algorithm C")]
    assert pdftext.literal_string(rb"a\(b\)(c)\101\n)x", 0) == (b"a(b)(c)A\n", 16)
    assert pdftext.heading([("x70.[M33]", 20.0), ("body", 10.0), ("body", 10.0)]) is None
    with pytest.raises(ValueError, match="PDF"):
        pdftext.pages_text(b"text")
    art, latex = pdftext.matrix([["1", "20"], ["3", "4"]])
    assert art == "⎡1 20⎤\n⎣3  4⎦" and latex == r"\begin{bmatrix} 1 & 20 \\ 3 & 4 \end{bmatrix}"


def test_ignore_rules():
    rules = tree.IgnoreRules({".gitignore": "*.log\n!keep.log\n/out\ndocs/\n", "sub/.gitignore": "x.md\n"})
    assert [rules.ignored(p) for p in ("a.log", "b/a.log", "keep.log", "out", "b/out", "docs/a.md", "sub/x.md", "x.md")] == [True, True, False, True, False, True, True, False]


def test_project_map_text():
    mk = lambda i, name, kind, sig, line, parent=None: {"sym_id": i, "name": name, "kind": kind, "signature": sig, "line": line, "end_line": line, "parent": parent, "language": "rust", "file": "crates/demo/src/state.rs"}
    rows = [mk(0, "State", "struct", "pub struct State", 1), mk(1, "LIMIT", "const", "const LIMIT: usize = 5;", 2), mk(2, "db", "field", "db: Db", 3, 0), mk(3, "impl State", "impl", "impl State", 4), mk(4, "open", "method", "pub fn open(p: &Path) -> Self", 5, 3)]
    got = render.project_map(rows)
    assert got.endswith("@ crates/demo/src/state.rs\ns#0 State :1-1\n  v#2 db: Db :3-3\nk#1 LIMIT: usize = 5 :2-2\nc#3 impl State :4-4\n  m#4 open(p: &Path) -> Self :5-5\n\n")
    assert "s#0" not in render.project_map(rows, kinds={"method"}) and "c#3" in render.project_map(rows, kinds={"method"})
    assert render.project_map(rows, max_tokens=30).endswith("... (truncated)\n")


def test_search_rendering():
    hit = {"file_path": "a.rs", "start_line": 1, "end_line": 90, "content": "\n".join(f"line {i}" for i in range(90)), "score": 0.5, "symbol_kind": "function", "symbol_qualified": "f"}
    assert render.search_results([]) == "  no results\n"
    text = render.search_results([hit, hit])
    assert text.count("…") == 2 and text.startswith("#1 0.5000\na.rs:1-90\n    line 0\n")
    page = hit | {"symbol_kind": "document", "symbol_qualified": "Chapter 2 · p.1-3", "content": "Prose here.\nExample: x = 1"}
    assert "  Title: Chapter 2\n  Description: Prose here.\n  Example: x = 1\n" in render.search_results([page], [hit])
    assert "omitted" in render.search_results([hit] * 50, budget=3_000)


def test_streaming(spark, tmp_path):
    schema = "project string, path string, ts timestamp"
    mk = lambda xs: spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{p}', '{f}', timestamp'2024-01-01 00:00:{s:02d}')" for p, f, s in xs) + " AS t(project, path, ts)")
    events = mk([("p", "a.rs", 0), ("p", "a.rs", 1), ("p", "b.rs", 5), ("q", "x.lock", 1)])
    assert sorted((r.project, r.n) for r in sync.debounce(events).collect()) == [("p", 1), ("p", 2), ("q", 1)]
    assert [r.project for r in sync.dirty_projects(sync.relevant(events)).collect()] == ["p"]
    source, seen = str(tmp_path / "in"), []
    events.write.parquet(source)
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        q = spark.readStream.schema(schema).parquet(source)
        run = sync.watch(q, seen.append, str(tmp_path / "cp"))
        run.processAllAvailable()
        run.stop()
    assert seen == [["p", "q"]]


def test_sync_batch(spark, tmp_path):
    from marlstone.operators.store import Table

    files, done = Table(spark, str(tmp_path / "files")), []
    mk = lambda xs: spark.createDataFrame(xs, "file_path string, digest string")
    run = lambda xs: sync.sync_batch(mk(xs), files, lambda d: done.append(sorted(r.file_path for r in d.collect())), lambda d: None)
    assert run([("a", "1"), ("b", "1")]) == {"added": 2}
    assert run([("a", "1"), ("b", "1")]) == {"unchanged": 2}
    assert run([("b", "2")]) == {"removed": 1, "modified": 1}
    assert done == [["a", "b"], ["b"]] and files.read().select(F.max("digest")).first()[0] == "2"
