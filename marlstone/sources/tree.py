"""A source tree as a table: listed on the driver, filtered by path before anything is read, read in tasks.

Spark's binary file source leaves out names that begin with an underscore, so files are listed through the file system
and read by path. Columns: file_path (relative), language, kind, file_type, size_bytes, mtime_ns, digest, content.
Text that is no valid UTF-8 is left out; PDF files become page texts with form feeds.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import classify
from marlstone.sources.pdftext import pages_text

MANIFEST_CAP = 2_048


class IgnoreRules:
    """Rules of .gitignore files: the last that matches decides; rules hold below their file's directory."""

    def __init__(self, files: dict[str, str]):
        self.rules = []
        for path, text in sorted(files.items(), key=lambda kv: kv[0].count("/")):
            base = posixpath.dirname(path)
            for line in text.splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line.lstrip("!")
                only_dir, anchored = line.endswith("/"), "/" in line.strip("/") or line.startswith("/")
                pattern = line.strip("/")
                glob = pattern if anchored else f"**/{pattern}"
                body = classify.glob_to_regex(glob)[1:-1]
                prefix = re.escape(base + "/") if base else ""
                self.rules.append((re.compile(f"^{prefix}{body}{'/.+' if only_dir else '(?:/.+)?'}$"), keep))

    def ignored(self, path: str) -> bool:
        out = False
        for pattern, keep in self.rules:
            if pattern.match(path):
                out = not keep
        return out


def _read(path: str) -> bytes:
    if path.startswith("file:"):
        with open(re.sub(r"^file:/+", "/", path), "rb") as f:
            return f.read()
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def list_files(spark: SparkSession, root: str) -> list[tuple[str, str, int, int]]:
    """(relative path, URI, bytes, modification ns) of all files below root, hidden directories aside."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(path).toString().rstrip("/") + "/"
    out, todo = [], [system.makeQualified(path)]
    while todo:
        for s in system.listStatus(todo.pop()):
            uri = s.getPath().toString()
            rel = uri[len(base) :]
            name = rel.rsplit("/", 1)[-1]
            if s.isDirectory():
                if not name.startswith(".") and name not in classify.SKIP_DIRS:
                    todo.append(s.getPath())
            else:
                out.append((rel, uri, s.getLen(), s.getModificationTime() * 1_000_000))
    return sorted(out)


def walk(spark: SparkSession, root: str, keep_manifests: bool = False) -> DataFrame:
    """The files that an index holds; headings are those of a PDF file's pages."""
    listed = list_files(spark, root)
    rules = IgnoreRules({rel: _read(uri).decode("utf-8", "replace") for rel, uri, _, _ in listed if rel.rsplit("/", 1)[-1] == ".gitignore"})
    tops = {rel.split("/", 1)[0] for rel, *_ in listed if "/" in rel}
    nested = sorted({posixpath.dirname(rel) for rel, *_ in listed if posixpath.basename(rel) == "foundry.toml"})
    rows = [r for r in listed if not rules.ignored(r[0])]
    schema = "file_path string, uri string, size_bytes bigint, mtime_ns bigint"
    files = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    path = F.col("file_path")
    manifest = classify.basename(path).isin(*classify.MANIFESTS)
    good = ~classify.in_skipped_dir(path) & ~classify.is_platform_scaffolding(path, bool(tops & {"lib", "src"}))
    good &= manifest if keep_manifests else ~classify.is_ignored_basename(path)
    for d in nested:
        prefix = d + "/" if d else ""
        for dep in classify.NESTED_DEPENDENCY_DIRS:
            good &= ~path.startswith(f"{prefix}{dep}/")
    kept = files.where(good).withColumn("kind", classify.source_kind(path)).withColumn("language", classify.label(path)).withColumn("file_type", classify.file_type(path))

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                raw = _read(r.uri)
                try:
                    pages = pages_text(raw) if r.kind == "pdf" else []
                    text = "\n\f\n".join(p[0] for p in pages) if r.kind == "pdf" else raw.decode("utf-8")
                except (UnicodeDecodeError, ValueError):
                    continue
                out.append((r.file_path, r.language, r.kind, r.file_type, r.size_bytes, r.mtime_ns, hashlib.sha256(raw).hexdigest(), text, [p[1] for p in pages]))
            yield pd.DataFrame(out, columns=["file_path", "language", "kind", "file_type", "size_bytes", "mtime_ns", "digest", "content", "headings"])

    n = max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4))
    return kept.repartition(n).mapInPandas(load, "file_path string, language string, kind string, file_type int, size_bytes bigint, mtime_ns bigint, digest string, content string, headings array<string>")


def preamble(manifests: DataFrame, cap: int = MANIFEST_CAP) -> DataFrame:
    """(file_path, content) of manifests, each cut to cap bytes with a mark; those at the root first, then by path."""
    from marlstone.functions.text import byte_prefix

    short = F.when(F.octet_length("content") > cap, F.concat(byte_prefix(F.col("content"), cap), F.lit("\n..."))).otherwise(F.col("content"))
    return manifests.select("file_path", short.alias("content")).orderBy(F.col("file_path").contains("/"), "file_path")


def _text(system, path) -> str:
    if not system.exists(path):
        return ""
    return _read(system.makeQualified(path).toString()).decode("utf-8", "replace")


def locked_version(lock: str, manifest: str, package: str) -> str | None:
    """The version of a package by the text of a crate lock file, or of a node manifest (without its caret)."""
    for block in lock.split("[[package]]")[1:]:
        fields = dict(re.findall(r'^(name|version) = "([^"]*)"', block, re.M))
        if fields.get("name") == package:
            return fields.get("version")
    try:
        found = json.loads(manifest) if manifest.strip() else {}
    except ValueError:
        return None
    for group in ("dependencies", "devDependencies"):
        version = (found.get(group) or {}).get(package) if isinstance(found, dict) else None
        if isinstance(version, str):
            return version.lstrip("^")
    return None


def dependency_root(spark: SparkSession, root: str, package: str, home: str) -> str | None:
    """Where the sources of a project's dependency lie: in the project, else in a crate registry (of the locked version, else
    the greatest by name), else in a package cache. None if nowhere."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    base = make(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    version = locked_version(_text(system, make(base, "Cargo.lock")), _text(system, make(base, "package.json")), package)
    crates = f"{home}/.cargo/registry/src/*/{package}-"
    places = [f"{root}/node_modules/{package}", f"{root}/lib/{package}"]
    places += [f"{crates}{version}"] if version else []
    places += [f"{crates}[0-9]*", f"{home}/.pub-cache/hosted/pub.dev/{package}-*"]
    for place in places:
        found = [s.getPath().toString() for s in system.globStatus(make(place)) or [] if s.isDirectory()]
        if found:
            return max(found)
    return None
