"""Symbol graph: aliases, edge resolution, traversal.

symbols: sym_id, kind, name, qualified, file, line, end_line, signature, doc, parent, language.
edges: from_id, to_name, kind (call or ref), line. imports: file, local_name, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Directories and file names that are no modules, and suffixes cut from file names.
SOURCE_ROOTS = ("src", "lib", "app", "source", "Sources", "include")
ROOT_FILES = ("lib", "main", "mod", "index")
RUST_ROOT_FILES = ("lib", "main", "mod")
STEM_SUFFIX = r"\.(rs|ts|tsx|dart|sol)$"
APPENDIX_DEPTH, APPENDIX_CAP = 2, 32
CANDIDATE_ALIASES = 3


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), STEM_SUFFIX, "")


def crate_path(path: Column, root_name: str) -> Column:
    """For Rust files of a crate: the crate's name and the modules below it, as an array; null elsewhere."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    rest = (
        F.when((at(1) == "crates") & (at(2) == "apps") & (at(4) == "src"), F.concat(F.array(at(3)), F.slice(parts, 5, 1000)))
        .when((at(1) == "crates") & (at(3) == "src"), F.concat(F.array(at(2)), F.slice(parts, 4, 1000)))
        .when(at(1) == "src", F.concat(F.array(F.lit(root_name)), F.slice(parts, 2, 1000)))
    )
    stems = F.transform(rest, lambda p, i: F.replace(F.when(i == 0, p).otherwise(stem(p)), F.lit("-"), F.lit("_")))
    return F.filter(stems, lambda p, i: (i == 0) | ((p != "") & ~p.isin(*RUST_ROOT_FILES)))


def aliases(symbols: DataFrame, root_name: str = "root") -> DataFrame:
    """(alias, sym_id): names under which a symbol is found; of several symbols the first (by id) has the alias.

    A bare name counts only if one symbol bears it, and so does a qualified name that is the bare one.
    """
    counts = symbols.groupBy("name").agg(F.count("*").alias("n_named"))
    s = symbols.join(counts, "name")
    unique = F.col("n_named") == 1
    file_stem = stem(F.col("file"))
    dirs = F.split(F.regexp_replace("file", "/?[^/]*$", ""), "/")
    prefix = F.array_join(F.filter(dirs, lambda d: (d != "") & ~d.isin(*SOURCE_ROOTS)), "::")
    crate = F.when(F.col("language") == "rust", crate_path(F.col("file"), root_name))
    crate = F.when((F.size(crate) == 1) & ~file_stem.isin(*RUST_ROOT_FILES), F.concat(crate, F.array(F.replace(file_stem, F.lit("-"), F.lit("_"))))).otherwise(crate)
    rules = [
        F.when((F.col("qualified") != F.col("name")) | unique, F.col("qualified")),
        F.when(file_stem != F.col("name"), F.concat_ws("::", file_stem, F.col("name"))),
        F.when(prefix != "", F.concat_ws("::", prefix, F.col("qualified"))),
        F.when((prefix != "") & ~file_stem.isin(*ROOT_FILES), F.concat_ws("::", prefix, file_stem, F.col("qualified"))),
        F.when(crate.isNotNull(), F.concat_ws("::", F.array_join(crate, "::"), F.col("qualified"))),
        F.when(unique, F.col("name")),
    ]
    given = s.select("sym_id", F.explode(F.filter(F.array(*rules), lambda a: a.isNotNull())).alias("alias"))
    return given.groupBy("alias").agg(F.min("sym_id").alias("sym_id"))


def resolve(edges: DataFrame, symbols: DataFrame, alias_table: DataFrame, imports: DataFrame, root_name: str = "root") -> DataFrame:
    """edges with to_id, state (resolved or external) and to_name of external targets (marked *).

    In turn: the alias; the import's source, then source::name; a symbol of that name in the same file; for paths into
    a crate of the project, the last part as an alias. Paths from crate::, self:: and super:: are made absolute first.
    """
    sources = symbols.select(F.col("sym_id").alias("from_id"), F.col("file").alias("from_file"), F.col("language").alias("from_language"))
    e = edges.join(sources, "from_id", "left")
    crate = F.when(F.col("from_language") == "rust", crate_path(F.col("from_file"), root_name))
    rest = F.regexp_extract("to_name", "^[^:]*::(.*)$", 1)
    absolute = (
        F.when(crate.isNull() | ~F.col("to_name").contains("::"), F.col("to_name"))
        .when(F.col("to_name").startswith("crate::"), F.concat_ws("::", F.element_at(crate, 1), rest))
        .when(F.col("to_name").startswith("self::"), F.concat_ws("::", F.array_join(crate, "::"), rest))
        .when(F.col("to_name").startswith("super::"), F.concat_ws("::", F.array_join(F.slice(crate, 1, F.greatest(F.size(crate) - 1, F.lit(1))), "::"), rest))
        .otherwise(F.col("to_name"))
    )
    e = e.withColumn("target", absolute)
    named = lambda col, out: alias_table.select(F.col("alias").alias(col), F.col("sym_id").alias(out))
    imported = imports.select(F.col("file").alias("from_file"), F.col("local_name").alias("target"), F.col("source").alias("import_source")).dropDuplicates(["from_file", "target"])
    local = symbols.groupBy(F.col("file").alias("from_file"), F.col("name").alias("target")).agg(F.min("sym_id").alias("local_id"))
    crates = (
        symbols.where(F.col("language") == "rust").select(F.element_at(crate_path(F.col("file"), root_name), 1).alias("head")).where("head IS NOT NULL").distinct().withColumn("own_crate", F.lit(True))
    )
    e = (
        e.join(named("target", "alias_id"), "target", "left")
        .join(imported, ["from_file", "target"], "left")
        .join(local, ["from_file", "target"], "left")
        .withColumn("import_name", F.concat_ws("::", "import_source", "target"))
        .withColumn("head", F.when(F.col("target").contains("::"), F.substring_index("target", "::", 1)))
        .withColumn("leaf", F.when(F.col("target").contains("::"), F.substring_index("target", "::", -1)))
        .join(named("import_source", "import_id"), "import_source", "left")
        .join(named("import_name", "import_leaf_id"), "import_name", "left")
        .join(crates, "head", "left")
        .join(named("leaf", "leaf_id"), "leaf", "left")
    )
    via_import = F.when(F.col("import_source").isNotNull(), F.coalesce("import_id", "import_leaf_id"))
    to_id = F.coalesce(F.col("alias_id"), via_import, F.col("local_id"), F.when(F.col("own_crate"), F.col("leaf_id")))
    return e.select(
        "from_id",
        to_id.alias("to_id"),
        F.when(to_id.isNull(), F.concat(F.lit("*"), "target")).alias("to_name"),
        F.when(to_id.isNull(), "external").otherwise("resolved").alias("state"),
        "kind",
        "line",
    )


def reverse(edges: DataFrame) -> DataFrame:
    """Who points at whom: resolved edges only."""
    return edges.where(F.col("to_id").isNotNull()).select(F.col("to_id").alias("sym_id"), F.col("from_id").alias("caller_id"), "kind", "line")


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): what calls lead to within depth steps, each at its least depth. starts: (node).

    Each step keeps one row per (start, node), so its size is bounded by the pairs reached, not by the paths.
    """
    steps = edges.where(F.col("to_id").isNotNull()).select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).distinct()
    seen = starts.select(F.col("node").alias("start"), "node").withColumn("depth", F.lit(0))
    edge_front = seen
    for d in range(1, depth + 1):
        more = edge_front.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        edge_front = more.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(edge_front)
    return seen


def appendix_ids(edges: DataFrame, chunked: DataFrame, depth: int = APPENDIX_DEPTH, cap: int = APPENDIX_CAP) -> DataFrame:
    """(sym_id, appendix_sym_ids): callees within depth that have passages, nearest first (then by id), at most cap.

    A callee without passages is not walked through. chunked: (sym_id) of symbols with passages.
    """
    own = chunked.select("sym_id").distinct()
    calls = (
        edges.where((F.col("kind") == "call") & F.col("to_id").isNotNull())
        .select("from_id", "to_id")
        .distinct()
        .join(own.select(F.col("sym_id").alias("to_id")), "to_id", "left_semi")
        .select("from_id", "to_id")
    )
    found = reach(calls.join(own.select(F.col("sym_id").alias("from_id")), "from_id", "left_semi"), own.select(F.col("sym_id").alias("node")), depth)
    w = Window.partitionBy("start").orderBy("depth", "node")
    near = found.where("depth > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    return near.groupBy(F.col("start").alias("sym_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "node"))), lambda x: x["node"]).alias("appendix_sym_ids"))


def tree(edges: DataFrame, root: int, depth: int, callers: bool = False) -> DataFrame:
    """(node, parent, depth): breadth-first tree of callees or callers of one symbol; each node once, at its least depth and parent."""
    steps = edges.where(F.col("to_id").isNotNull()).select("from_id", "to_id").distinct()
    steps = steps.select(F.col("to_id" if callers else "from_id").alias("parent"), F.col("from_id" if callers else "to_id").alias("node"))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(root, None, 0)], "node bigint, parent bigint, depth int")
    front = seen
    for d in range(1, depth + 1):
        more = steps.join(front.select(F.col("node").alias("parent")), "parent").groupBy("node").agg(F.min("parent").alias("parent"))
        front = more.join(seen.select("node"), "node", "left_anti").select("node", "parent", F.lit(d).alias("depth"))
        seen = seen.unionByName(front)
    return seen


def entry_points(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that no resolved call reaches."""
    called = edges.where((F.col("kind") == "call") & F.col("to_id").isNotNull()).select(F.col("to_id").alias("sym_id"))
    return symbols.join(called, "sym_id", "left_anti")


def call_chains(edges: DataFrame, symbols: DataFrame, target: int, depth: int, most: int = 10_000) -> DataFrame:
    """(path, n): simple paths from an entry point to the target, of at most depth calls; by length, then by the path.

    Their number can grow exponentially with the depth; more than ``most`` is an error, not a cut.
    """
    calls = edges.where((F.col("kind") == "call") & F.col("to_id").isNotNull()).select("from_id", "to_id").distinct()
    entries = entry_points(edges, symbols).select(F.col("sym_id").alias("head"))
    paths = edges.sparkSession.createDataFrame([([target],)], "path array<bigint>")
    out = paths
    for _ in range(depth):
        paths = (
            paths.withColumn("head", F.element_at("path", 1))
            .join(calls.select(F.col("to_id").alias("head"), "from_id"), "head")
            .where(~F.array_contains("path", F.col("from_id")))
            .select(F.concat(F.array("from_id"), "path").alias("path"))
        )
        out = out.unionByName(paths)
    found = out.withColumn("head", F.element_at("path", 1)).join(entries, "head", "left_semi").select("path", F.size("path").alias("n"))
    too_many = found.agg(F.count("*").alias("total"))
    return (
        found.crossJoin(F.broadcast(too_many))
        .where(F.when(F.col("total") > most, F.raise_error(F.lit(f"more than {most} call chains; lower the depth"))).otherwise(F.lit(None)).cast("boolean").isNull())
        .select("path", "n")
        .orderBy("n", "path")
    )


def resolve_name(alias_table: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """(match, sym_id): found by alias; else all symbols of that name or qualified name, as found, ambiguous or none."""
    hit = alias_table.where(F.col("alias") == name).select("sym_id")
    same = symbols.where((F.col("name") == name) | (F.col("qualified") == name)).select("sym_id")
    both = hit.withColumn("rule", F.lit(0)).unionByName(same.withColumn("rule", F.lit(1)))
    best = both.agg(F.min("rule").alias("best"))
    ids = both.crossJoin(F.broadcast(best)).where("rule = best").select("sym_id").distinct()
    count = ids.agg(F.count("*").alias("n"))
    return count.crossJoin(ids.agg(F.sort_array(F.collect_list("sym_id")).alias("ids"))).select(
        F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("match"), F.explode_outer("ids").alias("sym_id")
    )


def candidate_aliases(symbols: DataFrame, alias_table: DataFrame, most: int = CANDIDATE_ALIASES) -> DataFrame:
    """(sym_id, alias, rank): the best names of each symbol to ask again with."""
    counts = symbols.groupBy("name").agg(F.count("*").alias("n_named"))
    s = alias_table.join(symbols.join(counts, "name").select("sym_id", "name", "qualified", "n_named"), "sym_id")
    ends = F.substring_index("alias", "::", -1) == F.col("name")
    parts = F.size(F.split("alias", "::"))
    rank = (
        F.when((F.col("alias") == F.col("qualified")) & (parts > 1), 0)
        .when(ends & (parts == 2), 1)
        .when(ends & (parts > 1) & ~F.col("alias").startswith("crates::") & ~F.col("alias").contains("-"), 2)
        .otherwise(3)
    )
    usable = s.where((F.col("n_named") == 1) | (parts > 1)).withColumn("rule", rank)
    w = Window.partitionBy("sym_id").orderBy("rule", "alias")
    return usable.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("sym_id", "alias", "rank")


def bodies(ids: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(sym_id, ok, body or error) for each asked id. files: file, content."""
    asked = ids.select("sym_id").join(symbols.select("sym_id", "file", "line", "end_line"), "sym_id", "left").join(files.select("file", "content"), "file", "left")
    body = F.array_join(F.slice(F.split("content", "\n", -1), F.col("line").cast("int"), (F.col("end_line") - F.col("line") + 1).cast("int")), "\n")
    return asked.select(
        "sym_id",
        F.col("content").isNotNull().alias("ok"),
        body.alias("body"),
        F.when(F.col("file").isNull(), F.concat(F.lit("unknown symbol #"), F.col("sym_id").cast("string"))).when(F.col("content").isNull(), F.concat(F.lit("unreadable file "), "file")).alias("error"),
    )


def children(symbols: DataFrame) -> DataFrame:
    """(parent, child_ids by line)."""
    return symbols.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line", "sym_id"))), lambda x: x["sym_id"]).alias("child_ids")
    )


def kept_by_kind(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """Top-level symbols of one of the kinds or with such a descendant, however deep; each round goes up by one parent."""
    up = symbols.select("sym_id", "parent")
    front = symbols.where(F.col("kind").isin(*kinds)).select("sym_id").persist()
    seen = front
    while not front.isEmpty():
        above = up.join(front, "sym_id", "left_semi").where("parent IS NOT NULL").select(F.col("parent").alias("sym_id")).distinct()
        front = above.join(seen, "sym_id", "left_anti").persist()
        seen = seen.unionByName(front)
    return symbols.where("parent IS NULL").join(seen, "sym_id", "left_semi")
