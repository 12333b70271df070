"""The engine: index a tree, search it, look up symbols, and keep a catalogue of projects, all as versioned tables."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import render
from marlstone.operators import changes, chunking, classify, embed, graph, lexical, quantize, rank, splitter, vector
from marlstone.operators.store import Table
from marlstone.sources import extract, tree

INDEX_VERSION = 2
ENDS = ("done", "cancelled", "failed")
PHASES = ("scan", "diff", "parse", "chunk", "embed", "write", "index", "finish")


class Engine:
    def __init__(self, spark: SparkSession, data_dir: str, model=None, dim: int = 64, max_tokens: int = 512, model_id: str = "", batch_files: int = 10_000):
        self.spark, self.base, self.dim, self.max_tokens, self.batch_files = spark, data_dir.rstrip("/"), dim, max_tokens, batch_files
        self.model, self.model_id = model or embed.HashingModel(dim), model_id
        self.projects = Table(spark, f"{self.base}/projects")

    def _table(self, root: str, name: str) -> Table:
        return Table(self.spark, f"{self.base}/{hashlib.sha256(root.encode()).hexdigest()[:16]}/{name}")

    def _text_index(self, root: str) -> lexical.TextIndex:
        return lexical.TextIndex(self.spark, self._table(root, "text").path, ("content", "symbol_qualified"))

    def index(self, root: str, refresh: bool = False, progress: Callable[[str], None] = lambda _: None, control: Callable[[], str] = lambda: "run") -> dict:
        """Brings a project's tables up to date and returns the numbers of changed paths and passages.

        Changed files are taken in batches of about batch_files; a batch's files are recorded when its passages are in
        the table, so a run that broke off or was cancelled is resumed by the next. Before each batch ``control`` says
        "run", "pause" (asked again every second) or "cancel"; a cancelled run says so in "cancelled". ``progress`` gets
        each of PHASES as it begins and one of ENDS at last.
        """
        try:
            done = self._index(root.rstrip("/"), refresh, progress, control)
        except BaseException:
            progress("failed")
            raise
        progress("cancelled" if done["cancelled"] else "done")
        return done

    def _index(self, root: str, refresh: bool, progress: Callable[[str], None], control: Callable[[], str]) -> dict:
        chunks_t, files_t, symbols_t, edges_t = (self._table(root, n) for n in ("chunks", "files", "symbols", "edges"))
        progress("scan")
        snapshot = tree.walk(self.spark, root).cache()
        progress("diff")
        project = self._project(root)
        n_chunks = chunks_t.read().count() if chunks_t.exists() else 0
        n_files = files_t.read().count() if files_t.exists() else 0
        force = changes.must_rebuild(refresh, project["index_version"] if project else None, INDEX_VERSION, n_chunks, n_files)
        new = snapshot.select("file_path", "digest")
        found = changes.detect(files_t.read() if files_t.exists() and not force else new.limit(0), new).cache()
        counts = {c: 0 for c in ("added", "modified", "removed", "unchanged")} | {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
        written, cancelled = 0, False
        if force or counts["added"] + counts["modified"] + counts["removed"]:
            progress("parse")
            symbols, edges, imports = (t.cache() for t in extract.extract_all(snapshot.where("kind = 'code'")))
            resolved = graph.resolve(edges, symbols, graph.aliases(symbols, root.rsplit("/", 1)[-1]), imports, root.rsplit("/", 1)[-1])
            symbols_t.overwrite(symbols)
            edges_t.overwrite(resolved)
            todo = snapshot.join(changes.to_index(found, force).select("file_path"), "file_path", "left_semi").cache()
            recorded = ["file_path", "digest", "mtime_ns", "size_bytes", "language"]
            if force:
                for t in (chunks_t, files_t, self._text_index(root)):
                    t.drop()
                vector.IvfIndex.drop(self.spark, self._table(root, "vectors").path)
            elif counts["removed"]:
                gone = found.where("change = 'removed'")
                chunks_t.delete(gone, "file_path")
                files_t.delete(gone, "file_path")
            n = max(1, -(-todo.count() // self.batch_files))
            for i in range(n):
                while (said := control()) == "pause":
                    time.sleep(1)
                if said == "cancel":
                    cancelled = True
                    break
                batch = todo.where(F.pmod(F.xxhash64("file_path"), F.lit(n)) == i)
                progress("chunk")
                chunks = self._chunks(batch, symbols_t.read(), edges_t.read())
                progress("embed")
                passage = embed.prefixes(self.model_id)[1]
                chunks = chunks.withColumn("m_text", F.concat(F.lit(passage), "content"))
                chunks = quantize.encode(embed.embed(chunks, self.model, "m_text").drop("m_text"), self.dim).withColumn("indexed_at_ns", F.lit(time.time_ns()))
                progress("write")
                if chunks_t.exists():
                    chunks_t.delete(batch, "file_path")
                chunks_t.append(chunks)
                files_t.upsert(batch.select(*recorded), "file_path")
            if chunks_t.exists():
                done = todo.join(files_t.read().select("file_path", "digest"), ["file_path", "digest"], "left_semi") if files_t.exists() else todo.limit(0)
                written = chunks_t.read().join(done.select("file_path"), "file_path", "left_semi").count()
                progress("index")
                self._build_indexes(root, chunks_t.read())
            todo.unpersist()
        progress("finish")
        total = chunks_t.read().count() if chunks_t.exists() else 0
        self._record(root, snapshot, total, project)
        for df in (snapshot, found):
            df.unpersist()
        return counts | {"chunks_new": written, "chunks_total": total, "cancelled": cancelled}

    def _build_indexes(self, root: str, chunks: DataFrame) -> None:
        """The postings, and the vectors by cell where the chosen method has cells."""
        self._text_index(root).build(chunks, "id")
        p = vector.choose(chunks.count(), self.dim, 8 << 30)
        path = self._table(root, "vectors").path
        if p.method == "flat":
            vector.IvfIndex.drop(self.spark, path)
        else:
            vector.IvfIndex.build(chunks, p.num_partitions, id_column="id").write(path)

    def _nearest(self, root: str, project: dict, chunks: DataFrame, scope, query: list[float], k: int) -> DataFrame:
        """(id, score) by the project's method: all vectors, or those of the nearest cells."""
        index = None if project["search_method"] == "flat" else vector.IvfIndex.read(self.spark, self._table(root, "vectors").path)
        if index is None:
            return vector.knn(chunks, query, k, scope, "id").select("id", "score")
        among = chunks if scope is None else chunks.where(scope)
        return index.search(query, k, among=among.select(F.col("id").alias("vec_id"))).select(F.col("vec_id").alias("id"), "score")

    def _chunks(self, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
        columns = ["file_path", "sym_id", "symbol_qualified", "symbol_kind", "start_line", "end_line", "content"]
        budget = embed.chunk_budget(self.max_tokens, remote=False)
        code = chunking.symbol_chunks(extract.chunkable(symbols), files.where("kind = 'code'")).select(*columns)
        text = chunking.text_chunks(files.where("kind = 'text'")).select(*columns)
        none = [F.lit(chunking.NO_SYMBOL).alias("sym_id"), F.lit("document").alias("symbol_kind")]
        rows = chunking.pack_rows(files.where("kind IN ('tsv', 'psv')"), budget).select("file_path", none[0], "symbol_qualified", none[1], "start_line", "end_line", "content")
        pdf = files.where("kind = 'pdf'").select(F.col("file_path").alias("doc"), "content", "headings")
        pages = chunking.pack_pages(pdf, budget).select(F.col("doc").alias("file_path"), none[0], "symbol_qualified", none[1], "start_line", "end_line", "content")
        whole = code.unionByName(text).unionByName(rows).unionByName(pages).where(F.trim("content") != "")
        whole = whole.withColumn("sub_chunk_idx", F.lit(0).cast("long")).withColumn("total_sub_chunks", F.lit(1).cast("long")).withColumn("chunk_strategy", F.lit(0))
        cut = splitter.split_chunks(whole, self.max_tokens, 8)
        related = graph.appendix_ids(edges, whole.where(F.col("sym_id") != chunking.NO_SYMBOL).select("sym_id"))
        facts = symbols.select("sym_id", F.col("parent").alias("parent_sym_id"))
        return (
            cut.join(files.select("file_path", "language", "file_type"), "file_path")
            .join(facts, "sym_id", "left")
            .join(related, "sym_id", "left")
            .withColumn("id", chunking.chunk_id(F.col("file_path"), F.col("symbol_qualified"), F.col("sub_chunk_idx"), F.col("content")))
        )

    def _project(self, root: str) -> dict | None:
        if not self.projects.exists():
            return None
        row = self.projects.read().where(F.col("root_path") == root).first()
        return row.asDict() if row else None

    def _record(self, root: str, snapshot: DataFrame, total: int, before: dict | None) -> None:
        now = time.time_ns()
        found = snapshot.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("language")).alias("l")).first()
        p = vector.choose(total, self.dim, 8 << 30)
        row = (root, found["l"], self.dim, total, found["n"], now, before["created_at_ns"] if before else now, INDEX_VERSION, p.method)
        schema = "root_path string, languages array<string>, model_dim int, total_chunks bigint, total_files bigint, last_indexed_ns bigint, created_at_ns bigint, index_version int, search_method string"
        self.projects.upsert(self.spark.createDataFrame([row], schema), "root_path")

    def search(self, root: str, text: str, limit: int = 5, languages: list[str] | None = None, path_glob: str | None = None, include_tests: bool = False, exhaustive: bool = False, mode: str = "query") -> DataFrame:
        """Ranked passages: id, score and what is shown of each; empty results are tried again exhaustively.

        mode is "query" for a question, "passage" for a text like those of the index; models embed these differently.
        """
        root = root.rstrip("/")
        project = self._project(root)
        if project is None:
            raise LookupError(f"no such project: {root}")
        if project["index_version"] != INDEX_VERSION:
            raise LookupError(f"the index of {root} is of version {project['index_version']}; index it again")
        if mode not in ("query", "passage"):
            raise ValueError(f"no such mode: {mode}")
        include_tests = include_tests or classify.mentions_tests(text)
        chunks = self._table(root, "chunks").read()
        scope = classify.scope(languages, path_glob, include_tests)
        fetch = vector.over_fetch(limit, project["total_chunks"], exhaustive)
        query = self.model([embed.prefixes(self.model_id)[mode == "passage"] + text])[0].tolist()
        vec = self._nearest(root, project, chunks, scope, query, fetch)
        index = self._text_index(root)
        lex = index.search(text, fetch, chunks if scope is None else chunks.where(scope)) if index.exists() else lexical.bm25(chunks, text, fetch, "id", index.fields, scope)
        fused = rank.rrf([rank.ranked(vec), rank.ranked(lex)], fetch)
        shown = chunks.select("id", "file_path", "file_type", "symbol_qualified", "symbol_kind", "sym_id", "parent_sym_id", "start_line", "end_line", "content", "appendix_sym_ids", "turbo_code")
        hits = fused.join(shown, "id")
        if not exhaustive:
            hits = rank.rerank(fused, quantize.boosts(hits, query)).join(shown, "id")
            hits = rank.diversify(rank.dedup_symbols(hits))
        page = rank.tier_sort(hits.drop("turbo_code"), limit)
        if not exhaustive and page.isEmpty():
            return self.search(root, text, limit, languages, path_glob, include_tests, exhaustive=True, mode=mode)
        return page

    def search_text(self, root: str, text: str, limit: int = 5, below: str = "", **options) -> str:
        """The page as text; paths are shown as seen from the folder ``below`` of the project."""
        found = self.search(root, text, limit, **options)
        rows = [r.asDict() for r in (found.withColumn("file_path", rank.relative_path(F.col("file_path"), below)) if below else found).collect()]
        page = [r | {"pos": i} for i, r in enumerate(rows)]
        if not page:
            return render.search_results([])
        columns = "pos int, id string, file_path string, symbol_qualified string, sym_id bigint, start_line bigint, end_line bigint, appendix_sym_ids array<bigint>"
        names = [c.split()[0] for c in columns.split(", ")]
        df = self.spark.createDataFrame([tuple(r[n] for n in names) for r in page], columns)
        kept = {r["pos"] for r in rank.drop_overlaps(df).collect()}
        chunks = self._table(root.rstrip("/"), "chunks").read()
        ids = [r["id"] for r in rank.appendix(df.where(F.col("pos").isin(*kept)), chunks).collect()]
        related = [r.asDict() for r in chunks.where(F.col("id").isin(*ids)).select("file_path", "start_line", "end_line", "content", "symbol_kind", "symbol_qualified").collect()] if ids else []
        return render.search_results([r for r in page if r["pos"] in kept], related)

    def symbol(self, root: str, name: str, depth: int = 2) -> str:
        """What a name stands for: an overview, candidates to choose from, or that there is none."""
        symbols, edges = self._table(root.rstrip("/"), "symbols").read(), self._table(root.rstrip("/"), "edges").read()
        alias_table = graph.aliases(symbols, root.rstrip("/").rsplit("/", 1)[-1])
        found = graph.resolve_name(alias_table, symbols, name).collect()
        if found[0]["match"] == "none":
            return f"no symbol named {name}\n"
        ids = [r["sym_id"] for r in found]
        rows = {r["sym_id"]: r.asDict() for r in symbols.where(F.col("sym_id").isin(*ids)).collect()}
        if found[0]["match"] == "ambiguous":
            near = graph.candidate_aliases(symbols, alias_table).where(F.col("sym_id").isin(*ids)).orderBy("sym_id", "rank").collect()
            return render.candidates([rows[i] | {"aliases": [r["alias"] for r in near if r["sym_id"] == i]} for i in ids])
        below = [r.asDict() for r in graph.tree(edges.where("kind = 'call'"), ids[0], depth).collect()]
        chains = [r["path"] for r in graph.call_chains(edges, symbols, ids[0], depth).collect()]
        shown = {r["sym_id"]: r["qualified"] for r in symbols.where(F.col("sym_id").isin(*{r["node"] for r in below}, *{i for c in chains for i in c})).collect()}
        files = tree.walk(self.spark, root.rstrip("/")).select(F.col("file_path").alias("file"), "content")
        asked = self.spark.createDataFrame([(ids[0],)], "sym_id bigint")
        body = graph.bodies(asked, symbols, files).first()
        return render.overview(rows[ids[0]], [[shown.get(i, "?") for i in c] for c in chains], render.dependency_tree(ids[0], below, shown), body["body"] or body["error"])

    def project_map(self, root: str, max_tokens: int = 8_000, kinds: list[str] | None = None, path_glob: str | None = None) -> str:
        symbols = self._table(root.rstrip("/"), "symbols").read()
        if path_glob:
            symbols = symbols.where(F.col("file").rlike(classify.glob_to_regex(path_glob)))
        rows = [r.asDict() for r in symbols.orderBy("file", "line").collect()]
        manifests = tree.preamble(tree.walk(self.spark, root.rstrip("/"), keep_manifests=True)).collect()
        return render.project_map(rows, [(r["file_path"], r["content"]) for r in manifests], max_tokens, set(classify.parse_kinds(kinds)) if kinds else None)

    def file_tree(self, root: str, path_glob: str | None = None) -> str:
        files = self._table(root.rstrip("/"), "files").read()
        if path_glob:
            files = files.where(F.col("file_path").rlike(classify.glob_to_regex(path_glob)))
        return render.file_tree([r.asDict() for r in files.select("file_path", "language").collect()])

    def resolve_project(self, reference: str | None = None, cwd: str | None = None) -> str:
        """A project's root by its path, its number, or its last name; without reference the one around cwd, or the only one."""
        roots = sorted(r["root_path"] for r in self.status().collect())
        if reference is not None:
            exact = [r for r in roots if r == reference.rstrip("/")]
            number = [roots[int(reference) - 1]] if reference.isdigit() and 0 < int(reference) <= len(roots) else []
            named = [r for r in roots if r.rsplit("/", 1)[-1] == reference]
            for found in (exact, number, named):
                if len(found) == 1:
                    return found[0]
        else:
            around = [r for r in roots if cwd and (cwd + "/").startswith(r + "/")]
            if around:
                return max(around, key=len)
            if len(roots) == 1:
                return roots[0]
        listed = "\n".join(f"  {i}. {r}" for i, r in enumerate(roots, 1))
        raise LookupError(f"which project? known are:\n{listed}")

    def dependency(self, root: str, package: str, home: str) -> str | None:
        """The folder with the sources of a project's dependency, to be indexed like any other."""
        return tree.dependency_root(self.spark, root.rstrip("/"), package, home.rstrip("/"))

    def methods(self) -> DataFrame:
        """(method, accuracy, speed, build, compression) of the search methods, for choosing by hand."""
        return self.spark.createDataFrame([(m, *v) for m, v in vector.METHODS.items()], "method string, accuracy int, speed int, build int, compression int")

    def status(self) -> DataFrame:
        schema = "root_path string, languages array<string>, model_dim int, total_chunks bigint, total_files bigint, last_indexed_ns bigint, created_at_ns bigint, index_version int, search_method string"
        return self.projects.read() if self.projects.exists() else self.spark.createDataFrame([], schema)

    def remove(self, root: str) -> None:
        """Forgets a project; an unknown one is no error."""
        root = root.rstrip("/")
        for name in ("chunks", "files", "symbols", "edges", "text", "vectors"):
            self._table(root, name).drop()
        if self.projects.exists():
            self.projects.delete(self.spark.createDataFrame([(root,)], "root_path string"), "root_path")

    def doctor(self, root: str | None = None) -> DataFrame:
        """(check, ok, detail): the model answers, the data folder can be written, tables can be read."""
        rows = []
        vectors = self.model(["check"])
        rows.append(("model_load", vectors.shape == (1, self.dim), f"{vectors.shape[1]} dimensions"))
        probe = Table(self.spark, f"{self.base}/probe")
        probe.overwrite(self.spark.range(1))
        rows.append(("data_dir_writable", probe.read().count() == 1, self.base))
        probe.drop()
        rows.append(("db_open", True, f"{self.status().count()} projects"))
        for name in ("chunks", "files") if root else ():
            t = self._table(root.rstrip("/"), name)
            rows.append((f"{name}_count", t.exists(), str(t.read().count() if t.exists() else 0)))
        return self.spark.createDataFrame(rows, "check string, ok boolean, detail string")
