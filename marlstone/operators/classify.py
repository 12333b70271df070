"""Path rules as column expressions: languages, source kinds, file types, ignore rules, scope and glob predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, extensions and patterns that decide how a path is treated.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "tsx", "dart": "dart", "sol": "solidity", "py": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go",
    "ml": "ocaml", "scilla": "ocaml", "scillib": "ocaml", "scilexp": "ocaml", "mli": "ocaml_interface",
}
LANGUAGE_ALIASES = {
    "rs": "rust", "rust": "rust", "ts": "typescript", "typescript": "typescript", "tsx": "tsx", "dart": "dart",
    "sol": "solidity", "solidity": "solidity", "py": "python", "python": "python", "js": "javascript",
    "javascript": "javascript", "go": "go", "ml": "ocaml", "ocaml": "ocaml", "scilla": "ocaml", "mli": "ocaml_interface",
}
KIND_ALIASES = {
    "fn": "function", "function": "function", "method": "method", "struct": "struct", "enum": "enum", "class": "class",
    "interface": "interface", "const": "const", "static": "static", "module": "module", "mod": "module", "field": "field",
    "variant": "variant", "impl": "impl", "typealias": "typealias", "type": "typealias", "event": "event",
    "error": "error", "document": "document",
}
CHUNKABLE_KINDS = ("function", "method", "struct", "enum", "typealias", "class", "interface")
MANIFESTS = ("Cargo.toml", "pubspec.yaml", "package.json", "foundry.toml")
ASSET_EXTS = ("svg", "ico", "woff", "woff2", "ttf", "eot", "otf")
SKIP_DIRS = (
    "node_modules", "vendor", "third_party", "Pods", ".pub-cache", ".dart_tool", "target", "DerivedData", ".gradle",
    "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "venv", ".venv", "env", "virtualenv", ".terraform",
    "_build", "deps",
)
PLATFORM_DIRS = ("ios", "android", "macos", "linux", "windows", "web", "rust_builder", "fastlane")
NESTED_DEPENDENCY_DIRS = ("lib", "cache", "out")
TEST_DIRS = ("test", "tests", "__tests__", "spec", "e2e", "integration_test")
DOC_EXTS = ("md", "mdx", "rst", "txt")
CONFIG_EXTS = ("toml", "yaml", "yml", "json", "ini", "cfg", "env")
GENERATED = (
    r"^frb_generated|\.(freezed|g|pb|pbjson|pbserver|grpc|gen|generated)\.dart$|\.(gen|generated)\.ts$"
    r"|\.min\.(js|css)$|\.(arb|mo)$"
)
FILE_TYPES = {"source": 0, "test": 1, "config": 2, "doc": 3}
#: Order of the tiers in a result list: source, config, doc, test.
TIER_RANK = {0: 0, 2: 1, 3: 2, 1: 3}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The part after the basename's last dot; none for names without one or with only a leading one."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def language(path: Column) -> Column:
    """The language by extension (case-sensitive); null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path))


def source_kind(path: Column) -> Column:
    """code, tsv, psv, pdf or text."""
    ext = extension(path)
    return F.when(language(path).isNotNull(), "code").when(ext.isin("tsv", "psv", "pdf"), ext).otherwise("text")


def label(path: Column) -> Column:
    """The language of code, else the kind."""
    return F.coalesce(language(path), source_kind(path))


def is_test_path(path: Column) -> Column:
    name = basename(path)
    return (
        F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in TEST_DIRS]))
        | name.rlike(r"(\.t\.sol|_test\.go|_test\.rs)$|\.test\.|\.spec\.|^test_")
    )


def file_type(path: Column) -> Column:
    """0 source, 1 test, 2 config, 3 doc."""
    kind = source_kind(path)
    # The text after the path's last dot, if no slash follows it.
    last = F.substring_index(path, ".", -1)
    return (
        F.when(is_test_path(path), 1)
        .when(kind == "code", 0)
        .when(kind != "text", 3)
        .when(last.isin(*CONFIG_EXTS), 2)
        .otherwise(3)
        .cast("int")
    )


def tier(file_type_column: Column) -> Column:
    out = F.lit(len(TIER_RANK))
    for kind, rank in TIER_RANK.items():
        out = F.when(file_type_column == kind, rank).otherwise(out)
    return out


def is_ignored_basename(path: Column) -> Column:
    name = basename(path)
    stem = F.regexp_extract(name, r"^[^.\-]*", 0)
    return (
        name.startswith(".")
        | name.isin(*MANIFESTS)
        | name.endswith(".lock")
        | name.contains("-lock.")
        | (F.upper(stem) == "LICENSE")
        | name.rlike(r"\.(" + "|".join(ASSET_EXTS) + r")$")
        | name.rlike(GENERATED)
    )


def in_skipped_dir(path: Column, extra: tuple[str, ...] = ()) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in (*SKIP_DIRS, *extra)])) | F.exists(dirs, lambda d: d.startswith("."))


def is_platform_scaffolding(path: Column, has_lib_or_src: bool) -> Column:
    first = F.substring_index(path, "/", 1)
    return F.lit(has_lib_or_src) & path.contains("/") & first.isin(*PLATFORM_DIRS)


def is_index_candidate(path: Column) -> Column:
    """What the walker keeps and the watcher reacts to, but for nested dependency roots."""
    return ~is_ignored_basename(path) & ~in_skipped_dir(path)


def glob_to_like(glob: str, strict: bool = True) -> str | None:
    """A LIKE pattern: ``*`` and ``**`` become %, ``**/`` swallows its slash, ``?`` becomes _.

    With strict, LIKE's own characters are escaped by a backslash; otherwise a glob that holds any of them (or a quote)
    gives None, which means no filter.
    """
    if not strict and re.search(r"['\\%_]", glob):
        return None
    out = re.sub(r"[\\%_]", lambda m: "\\" + m[0], glob)
    out = re.sub(r"\*\*/?", "\0", out)
    return out.replace("*", "%").replace("\0", "%").replace("?", "_")


def glob_to_regex(glob: str) -> str:
    """A true glob as a regular expression over the whole path; raises ValueError if brackets do not match."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed bracket in glob: {glob}")
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]"
            i = end
        elif c == "{":
            end = glob.find("}", i)
            if end < 0:
                raise ValueError(f"unclosed brace in glob: {glob}")
            out += "(?:" + "|".join(glob_to_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def scope(languages: list[str] | None = None, path_glob: str | None = None, include_tests: bool = False, strict_glob: bool = True,
          file_type_column: str = "file_type", language_column: str = "language", path_column: str = "file_path") -> Column | None:
    """The search scope; None if everything is in it. Language aliases are resolved, unknown ones dropped."""
    parts = []
    if not include_tests:
        parts.append(F.col(file_type_column) != FILE_TYPES["test"])
    known = [LANGUAGE_ALIASES.get(x.lower(), x.lower()) for x in languages or []]
    if known:
        parts.append(F.col(language_column).isin(*known))
    if path_glob:
        like = glob_to_like(path_glob, strict_glob)
        if like is not None:
            path = F.concat(F.lit("/"), F.col(path_column))
            parts.append(path.like("%/" + like))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def parse_languages(names: list[str]) -> list[str]:
    return [LANGUAGE_ALIASES[n.lower()] for n in names if n.lower() in LANGUAGE_ALIASES]


def parse_kinds(names: list[str]) -> list[str]:
    return [KIND_ALIASES[n] for n in names if n in KIND_ALIASES]


TEST_INTENT = r"(?i)(^|[^\p{Alnum}])tests?($|[^\p{Alnum}])"


def mentions_tests(query: str) -> bool:
    """asks_for_tests() of one query."""
    return re.search(r"(^|[^0-9a-z])tests?($|[^0-9a-z])", query.lower()) is not None


def asks_for_tests(query: Column) -> Column:
    """Whether the query has the word test or tests."""
    return query.rlike(TEST_INTENT)
