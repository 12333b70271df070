"""Text for people and tools from collected rows. Rows are dicts; every renderer stays within a byte budget."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from marlstone.functions.text import SIGNATURE_PREFIXES

# Budgets, marks and headings.
CHARS_PER_TOKEN = 4
MAX_LINES_PER_HIT = 40
SEARCH_BUDGET = 12_000
LEAST_BODY = 64
AST_HEADER = "Code AST. Use node #ID to fetch full code body."
LEGEND = "Types: @=File, f=fn, m=method, s=struct, c=class/impl, t=trait, e=enum, v=var/field/variant, d=mod, k=const, y=typealias"
MARKS = {
    "function": "f", "method": "m", "const": "k", "static": "k", "struct": "s", "enum": "e", "typealias": "y", "class": "c", "interface": "t",
    "module": "d", "field": "v", "variant": "v", "impl": "c", "event": "E", "error": "X", "document": "@",
}
LABELS = {"rust": "Rust", "typescript": "TypeScript", "tsx": "TSX", "javascript": "JavaScript", "python": "Python", "go": "Go", "dart": "Dart", "solidity": "Solidity", "ocaml": "OCaml", "ocaml_interface": "OCaml Interface"}


def short_signature(signature: str, language: str) -> str:
    words = "|".join(map(re.escape, SIGNATURE_PREFIXES.get(language, ())))
    out = signature.strip()
    return (re.sub(f"^(?:{words})+", "", out) if words else out).rstrip("{;, \t")


def clip(text: str, cap: int) -> str:
    raw = text.encode()
    return text if len(raw) <= cap else raw[:cap].decode("utf-8", "ignore")


def _hit(hit: dict, cap: int) -> str:
    head = f"{hit['file_path']}:{hit['start_line']}-{hit['end_line']}\n"
    room = cap - len(head.encode())
    if room < LEAST_BODY:
        return head + "    …\n"
    if hit.get("symbol_kind") == "document":
        return head + _document(hit, room)
    out = ""
    for n, line in enumerate(hit["content"].split("\n")[: len(hit["content"].splitlines())]):
        shown = f"    {line}\n"
        if n == MAX_LINES_PER_HIT:
            return head + out + "    …\n"
        if len((out + shown).encode()) > room:
            return head + out + "    ...\n"
        out += shown
    return head + out


def _document(hit: dict, room: int) -> str:
    """A passage of a document: its title, what stands before an example, and the example."""
    out, left = "", MAX_LINES_PER_HIT
    title = (hit.get("symbol_qualified") or "").rpartition(" · ")[0].strip()
    parts = [("Title", title)] if title else []
    text, example = hit["content"], ""
    m = re.search(r"^\s*Example:", text, re.M)
    if m:
        text, example = text[: m.start()], text[m.start() :]
    parts += [("Description", text.strip()), ("Example", re.sub(r"^\s*Example:\s*", "", example).strip())]
    for name, body in parts:
        lines = body.split("\n") if body else []
        for i, line in enumerate(lines):
            shown = f"  {name}: {line}\n" if i == 0 else f"    {line}\n"
            if not left or len((out + shown).encode()) > room:
                return out + "    ...\n"
            out, left = out + shown, left - 1
    return out


def search_results(hits: list[dict], appendix: list[dict] = (), budget: int = SEARCH_BUDGET) -> str:
    """Every hit gets the same share of the budget; related symbols share what is left."""
    if not hits:
        return "  no results\n"
    share, out, omitted = budget // len(hits), "", 0
    for i, hit in enumerate(hits):
        rank = f"#{i + 1} {hit['score']:.4f}\n"
        head = len(f"{hit['file_path']}:{hit['start_line']}-{hit['end_line']}\n".encode())
        if share < len(rank) + head + LEAST_BODY:
            omitted = len(hits) - i
            break
        out += rank + _hit(hit, share - len(rank))
    if appendix and len(out.encode()) < budget:
        out += "-- related:\n"
        for hit in appendix:
            room = budget - len(out.encode())
            head = len(f"{hit['file_path']}:{hit['start_line']}-{hit['end_line']}\n".encode())
            if room < head + LEAST_BODY:
                omitted += 1
                continue
            out += _hit(hit, room)
    notice = f"\n... ({omitted} results omitted — reduce `limit` or narrow query)\n"
    return out + notice if omitted and len((out + notice).encode()) <= budget else out


def _children(symbols: Iterable[dict]) -> dict:
    out = defaultdict(list)
    for s in symbols:
        out[s.get("parent")].append(s)
    for group in out.values():
        group.sort(key=lambda s: (s["line"], s["sym_id"]))
    return out


def project_map(symbols: list[dict], manifests: list[tuple[str, str]] = (), max_tokens: int = 8_000, kinds: set[str] | None = None) -> str:
    """Manifests, then by language and file the symbols, nested and in order of lines."""
    budget = max_tokens * CHARS_PER_TOKEN
    out = AST_HEADER + "\n\n"
    for path, text in manifests:
        out += f"@ {path}\n{text}\n\n"
        if len(out.encode()) >= budget:
            return out + "... (truncated)\n"
    below = _children(symbols)

    def wanted(s: dict) -> bool:
        return kinds is None or s["kind"] in kinds or any(wanted(c) for c in below[s["sym_id"]])

    def node(s: dict, depth: int) -> Iterable[str]:
        name = s["name"] if s["kind"] == "impl" else short_signature(s.get("signature") or "", s["language"]) or s["name"]
        semicolon = ";" if s["kind"] == "module" and s["line"] == s["end_line"] and (s.get("signature") or "").rstrip().endswith(";") and "{" not in s["signature"] else ""
        yield f"{'  ' * depth}{MARKS[s['kind']]}#{s['sym_id']} {name}{semicolon} :{s['line']}-{s['end_line']}\n"
        for c in below[s["sym_id"]]:
            yield from node(c, depth + 1)

    by_language = defaultdict(lambda: defaultdict(list))
    for s in below[None]:
        by_language[LABELS.get(s["language"], s["language"])][s["file"]].append(s)
    for label in sorted(by_language):
        out += f"## {label}\n{LEGEND}\n\n"
        for file, top in by_language[label].items():
            out += f"@ {file}\n"
            for s in filter(wanted, top):
                for line in node(s, 0):
                    out += line
                    if len(out.encode()) >= budget:
                        return out + "... (truncated)\n"
            out += "\n"
    return out


def file_tree(files: list[dict], numbered: bool = True) -> str:
    return "".join((f"#{i} [{f['language']}] " if numbered else "") + f["file_path"] + "\n" for i, f in enumerate(sorted(files, key=lambda f: f["file_path"])))


def dependency_tree(root: int, rows: list[dict], names: dict[int, str]) -> str:
    """rows: node, parent, depth."""
    below = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["depth"], r["node"])):
        if r["parent"] is not None:
            below[r["parent"]].append(r["node"])
    out = [f"{names.get(root, '?')} #{root}"]

    def walk(node: int, prefix: str) -> None:
        group = below[node]
        for i, child in enumerate(group):
            last = i + 1 == len(group)
            out.append(f"{prefix}{'└── ' if last else '├── '}{names.get(child, '?')} #{child}")
            walk(child, prefix + ("    " if last else "│   "))

    walk(root, "")
    return "\n".join(out) + "\n"


def candidates(rows: list[dict]) -> str:
    """rows: sym_id, kind, file, line, end_line, aliases."""
    out = "Ambiguous name — call searchDep again with one of these exact names:\n"
    for r in rows:
        first, *more = r["aliases"] or [r["qualified"]]
        extra = f" (aliases: {', '.join(more)})" if more else ""
        out += f"  #{r['sym_id']} : {r['kind']} {first}{extra} ({r['file']}:{r['line']}-{r['end_line']})\n"
    return out


def overview(symbol: dict, chains: list[list[str]], callees: str, body: str, max_tokens: int = 6_000) -> str:
    doc = (symbol.get("doc") or "").split("\n")[0].lstrip("/!* ").strip()
    out = f"{symbol['kind']} {symbol['qualified']} #{symbol['sym_id']}\n{symbol['file']}:{symbol['line']}-{symbol['end_line']}\n"
    out += f"{doc}\n" if doc else ""
    out += "".join(" → ".join(c) + "\n" for c in chains) + callees + body
    return clip(out, max_tokens * CHARS_PER_TOKEN)
