"""Symbols, calls and imports of source files.

Python is parsed by the standard library. For the other languages no grammar is at hand: declarations are found by
pattern in text whose comments and strings are blanked, and their ends by matching braces (OCaml: by the next
declaration of no deeper indent). This covers the usual declarations, not every construct of the grammars.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ID = r"[A-Za-z_$][\w$]*"
# Declarations by language as (kind, pattern with the name in group 1).
DECLARATIONS = {
    "rust": [
        ("function", rf"\bfn\s+({_ID})"), ("struct", rf"\bstruct\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("interface", rf"\btrait\s+({_ID})"),
        ("typealias", rf"\btype\s+({_ID})\s*(?:<[^=;]*>)?\s*="), ("const", rf"\bconst\s+({_ID})\s*:"), ("static", rf"\bstatic\s+(?:mut\s+)?({_ID})\s*:"), ("module", rf"\bmod\s+({_ID})"),
        ("impl", rf"\bimpl(?:<[^{{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_ID})"), ("function", rf"\bmacro_rules!\s+({_ID})"),
    ],
    "typescript": [
        ("function", rf"\bfunction\s*\*?\s+({_ID})"), ("class", rf"\bclass\s+({_ID})"), ("interface", rf"\binterface\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("typealias", rf"\btype\s+({_ID})[^=;]*="),
        ("function", rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>"), ("const", rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=(?!.*=>)"),
        ("method", rf"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*({_ID})\s*\([^;{{]*\)\s*(?::[^;{{]+)?\{{"),
    ],
    "go": [("function", rf"^func\s+({_ID})"), ("method", rf"^func\s+\([^)]*\)\s*({_ID})"), ("typealias", rf"^type\s+({_ID})")],
    "dart": [
        ("class", rf"\b(?:class|mixin|extension)\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("typealias", rf"\btypedef\s+({_ID})"),
        ("function", rf"^\s*(?:(?:static|external|abstract|override)\s+)*(?:[A-Za-z_][\w<>?,\s]*\s+)({_ID})\s*\([^;]*\)\s*(?:async\s*)?(?:\{{|=>)"), ("const", rf"^(?:final|const|var)\s+(?:[\w<>?]+\s+)?({_ID})\s*="),
    ],
    "solidity": [
        ("class", rf"\bcontract\s+({_ID})"), ("interface", rf"\binterface\s+({_ID})"), ("module", rf"\blibrary\s+({_ID})"), ("function", rf"\b(?:function|modifier)\s+({_ID})"), ("event", rf"\bevent\s+({_ID})"),
        ("error", rf"\berror\s+({_ID})\s*\("), ("struct", rf"\bstruct\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("method", r"\b(constructor|fallback|receive)\s*\("), ("typealias", rf"\btype\s+({_ID})\s+is"),
    ],
    "ocaml": [
        ("function", rf"^\s*let\s+(?:rec\s+)?({_ID})"), ("function", rf"^\s*external\s+({_ID})"), ("typealias", rf"^\s*type\s+(?:'\w+\s+)?({_ID})"), ("interface", rf"^\s*module\s+type\s+({_ID})"),
        ("module", rf"^\s*module\s+(?!type\b)({_ID})"), ("class", rf"^\s*class\s+({_ID})"), ("method", rf"^\s*method\s+({_ID})"), ("function", rf"^\s*val\s+({_ID})"),
    ],
}
for _like, _of in (("tsx", "typescript"), ("javascript", "typescript"), ("ocaml_interface", "ocaml")):
    DECLARATIONS[_like] = DECLARATIONS[_of]
CONTAINERS = ("struct", "enum", "interface", "module", "class", "impl")
TYPES = ("struct", "enum", "interface", "class", "impl")
NO_CALLS = frozenset("if for while switch match return fn function catch sizeof in not and or let where loop else elif with assert await new def class lambda yield del super".split())
IMPORTS = {
    "rust": rf"\buse\s+([\w:]+?)(?:::({_ID}))?\s*(?:as\s+({_ID}))?\s*;",
    "typescript": rf"import\s+(?:type\s+)?(?:\{{([^}}]*)\}}|({_ID}))\s*(?:,\s*\{{([^}}]*)\}})?\s*from\s*['\"]([^'\"]+)",
    "go": rf"^\s*(?:import\s+)?(?:({_ID})\s+)?\"([^\"]+)\"",
    "dart": r"import\s+'([^']+)'(?:\s+as\s+(\w+))?",
    "solidity": r"import\s+(?:\{([^}]*)\}\s*from\s*)?\"([^\"]+)\"",
    "ocaml": r"^\s*open\s+([\w.]+)",
}
_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\(\*.*?\*\)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'", re.S)
_DOC = re.compile(r"^\s*(?:///|//!|/\*\*|\*/|\*|#\[|@)")


def blank(text: str) -> str:
    """The text with comments and strings as spaces, of the same length."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def symbol_id(file: str, qualified: str, kind: str, nth: int) -> int:
    """63 bits that stay the same when lines move and other files change."""
    key = "\x1f".join((file, qualified, kind, str(nth)))
    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big") >> 1


def _block_end(clean: str, at: int) -> int:
    """Where the declaration that begins at ``at`` ends: its closing brace, or its semicolon or line end."""
    depth, opened = 0, False
    for i in range(at, len(clean)):
        c = clean[i]
        if c == "{":
            depth, opened = depth + 1, True
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + (depth == 0 and opened)
        elif c == ";" and not depth:
            return i + 1
    return len(clean)


def _braced(file: str, text: str, language: str) -> list[dict]:
    clean = text if language.startswith("ocaml") else blank(text)
    found, seen = [], set()
    for kind, pattern in DECLARATIONS[language]:
        for m in re.finditer(pattern, clean, re.M):
            at = m.start(1)
            if at in seen or (kind == "method" and m[1] in NO_CALLS):
                continue
            seen.add(at)
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append({"kind": kind, "name": m[1], "begin": begin, "at": at})
    found.sort(key=lambda s: s["begin"])
    for i, s in enumerate(found):
        if language.startswith("ocaml"):
            indent = s["begin"] - (clean.rfind("\n", 0, s["begin"]) + 1)
            s["end"] = next((t["begin"] for t in found[i + 1 :] if t["begin"] - (clean.rfind("\n", 0, t["begin"]) + 1) <= indent), len(clean))
            s["end"] = s["begin"] + len(clean[s["begin"] : s["end"]].rstrip())
        else:
            s["end"] = _block_end(clean, s["at"])
    return _nest(found, clean, text)


def _nest(found: list[dict], clean: str, text: str) -> list[dict]:
    lines = text.split("\n")
    open_: list[dict] = []
    out = []
    for s in found:
        while open_ and open_[-1]["end"] <= s["begin"]:
            open_.pop()
        parent = open_[-1] if open_ else None
        if parent and s["kind"] == "const" and parent["kind"] in ("function", "method"):
            continue
        if parent and s["kind"] == "function" and any(p["kind"] in TYPES for p in open_[-1:]):
            s["kind"] = "method"
        scope = [p["name"] for p in open_ if p["kind"] in CONTAINERS]
        s["qualified"] = "::".join([*scope, s["name"]])
        s["shown"] = f"impl {s['name']}" if s["kind"] == "impl" else s["name"]
        s["parent"] = parent
        s["line"], s["end_line"] = clean.count("\n", 0, s["begin"]) + 1, clean.count("\n", 0, max(s["end"] - 1, s["begin"])) + 1
        head = text[text.rfind("\n", 0, s["begin"]) + 1 : s["end"]]
        s["signature"] = re.sub(r"\s+", " ", re.split(r"[{;]", head, maxsplit=1)[0]).strip()
        above = []
        for line in reversed(lines[: s["line"] - 1]):
            if not _DOC.match(line):
                break
            above.append(line.strip())
        s["doc"] = "\n".join(reversed(above)) or None
        s["body"] = (s["at"] + len(s["name"]), s["end"])
        out.append(s)
        open_.append(s)
    return out


def _calls(symbols: list[dict], clean: str) -> Iterator[tuple[dict, str, str, int]]:
    for m in re.finditer(rf"(?<![\w$])((?:{_ID}(?:::|\.))*{_ID})(!?)\s*(?:::<[^>]*>)?\(", clean):
        name = m[1].replace(".", "::").removeprefix("this::") if "." in m[1] else m[1]
        leaf = name.rsplit("::", 1)[-1]
        if leaf in NO_CALLS:
            continue
        inner = [s for s in symbols if s["body"][0] <= m.start() < s["body"][1]]
        if inner and not any(s["at"] == m.start() for s in symbols):
            owner = max(inner, key=lambda s: s["begin"])
            yield owner, leaf if "." in m[1] else name, "call", clean.count("\n", 0, m.start()) + 1


def _imports(text: str, language: str) -> dict[str, str]:
    out: dict[str, str] = {}
    pattern = IMPORTS.get({"tsx": "typescript", "javascript": "typescript", "ocaml_interface": "ocaml"}.get(language, language))
    stem = lambda p: re.sub(r"\.\w+$", "", p.rsplit("/", 1)[-1])
    for m in re.finditer(pattern or "(?!)", text, re.M):
        g = m.groups()
        if language == "rust":
            local = g[2] or g[1] or g[0].rsplit("::", 1)[-1]
            out[local] = f"{g[0]}::{g[1]}" if g[1] else g[0]
        elif language in ("typescript", "tsx", "javascript"):
            for group in (g[0], g[2]):
                for part in (group or "").split(","):
                    if part.strip():
                        out[part.split(" as ")[-1].strip()] = stem(g[3])
            if g[1]:
                out[g[1]] = stem(g[3])
        elif language == "go":
            out[g[0] or g[1].rsplit("/", 1)[-1]] = g[1].rsplit("/", 1)[-1]
        elif language == "dart":
            out[g[1] or stem(g[0])] = stem(g[0])
        elif language == "solidity":
            for part in (g[0] or stem(g[1])).split(","):
                out[part.split(" as ")[-1].strip()] = stem(g[1])
        else:
            out[g[0].rsplit(".", 1)[-1]] = g[0].replace(".", "::")
    return out


def _python(text: str) -> tuple[list[dict], list[tuple], dict[str, str]]:
    tree = ast.parse(text)
    lines = text.split("\n")
    symbols, calls, imports = [], [], {}

    def visit(node, scope: list[str], parent: dict | None) -> None:
        for child in ast.iter_child_nodes(node):
            own = None
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent and parent["kind"] == "class" else "function"
                own = {"kind": kind, "name": child.name}
            elif isinstance(child, ast.Assign) and isinstance(child.targets[0], ast.Name) and (parent is None or parent["kind"] == "class"):
                own = {"kind": "const", "name": child.targets[0].id}
            elif isinstance(child, ast.Import):
                imports.update({a.asname or a.name.split(".")[0]: a.name.replace(".", "::") for a in child.names})
            elif isinstance(child, ast.ImportFrom):
                imports.update({a.asname or a.name: "::".join([*filter(None, [(child.module or "").rsplit(".", 1)[-1]]), a.name]) for a in child.names})
            if own:
                own |= {"qualified": "::".join([*scope, own["name"]]), "parent": parent, "line": child.lineno, "end_line": child.end_lineno, "signature": lines[child.lineno - 1].strip(), "doc": None,
                        "bases": [ast.unparse(b) for b in getattr(child, "bases", [])]}
                symbols.append(own)
            if isinstance(child, ast.Call) and parent:
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    calls.append((parent, name, "call", child.lineno))
            visit(child, scope + [own["name"]] if own and own["kind"] == "class" else scope, own or parent)

    visit(tree, [], None)
    return symbols, calls, imports


def extract(file: str, text: str, language: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of symbols, edges and imports of one file; none for files that cannot be parsed."""
    if language == "python":
        try:
            symbols, calls, imports = _python(text)
        except (SyntaxError, ValueError, RecursionError):
            return [], [], []
    elif language in DECLARATIONS:
        symbols = _braced(file, text, language)
        calls, imports = list(_calls(symbols, blank(text))), _imports(text, language)
    else:
        return [], [], []
    counts: dict[tuple, int] = {}
    for s in symbols:
        key = (s["qualified"], s["kind"])
        s["id"] = symbol_id(file, *key, counts.setdefault(key, 0))
        counts[key] += 1
    rows = [(s["id"], s["kind"], s.get("shown", s["name"]), s.get("shown", s["qualified"]) if s["kind"] == "impl" else s["qualified"], file, language, s["line"], s["end_line"], s["signature"], s["doc"], s["parent"]["id"] if s["parent"] else None, s.get("bases", [])) for s in symbols]
    return rows, [(s["id"], name, kind, line) for s, name, kind, line in calls], [(file, k, v) for k, v in imports.items()]


SYMBOLS = "sym_id bigint, kind string, name string, qualified string, file string, language string, line int, end_line int, signature string, doc string, parent bigint, base_classes array<string>"
EDGES = "from_id bigint, to_name string, kind string, line int"
IMPORT_ROWS = "file string, local_name string, source string"


def extract_all(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, edges, imports of (file_path, language, content). Files are parsed once per table read; cache or write what is used often."""

    def table(which: int, schema: str) -> DataFrame:
        names = [f.split()[0] for f in re.sub(r"array<string>", "a", schema).split(", ")]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                out = [r for f, t, lang in zip(pdf["file_path"], pdf["content"], pdf["language"], strict=True) for r in extract(f, t, lang)[which]]
                # Ids have 63 bits, so a column with nulls must not pass through floats.
                yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype="Int64" if n in ("sym_id", "from_id", "parent", "line", "end_line") else object) for i, n in enumerate(names)})

        return files.select("file_path", "language", "content").mapInPandas(run, schema)

    return table(0, SYMBOLS), table(1, EDGES), table(2, IMPORT_ROWS)


def chunkable(symbols: DataFrame) -> DataFrame:
    from marlstone.operators.classify import CHUNKABLE_KINDS

    return symbols.where(F.col("kind").isin(*CHUNKABLE_KINDS))
