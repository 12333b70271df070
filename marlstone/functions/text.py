"""Scalar functions on text, as column expressions where Spark has the pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that a shortened signature leaves out, by language, and what is cut from its end.
_TS = (
    "export default ", "export ", "declare ", "public ", "private ", "protected ", "async function ", "function ", "async ",
    "static ", "abstract ", "readonly ", "class ", "interface ", "enum ", "type ", "const ", "let ", "var ",
)
_OCAML = ("let ", "rec ", "val ", "type ", "module ", "external ")
SIGNATURE_PREFIXES = {
    "rust": (
        "pub(crate) ", "pub(super) ", "pub ", "unsafe fn ", "async fn ", "const fn ", "fn ", "unsafe ", "async ", "const ",
        "static ", "let ", "struct ", "enum ", "trait ", "mod ", "impl ", "type ",
    ),
    "typescript": _TS, "tsx": _TS, "javascript": _TS,
    "go": ("func ", "type "),
    "ocaml": _OCAML, "ocaml_interface": _OCAML,
    "python": ("async ", "def ", "class "),
    "dart": (
        "abstract ", "external ", "factory ", "static ", "late ", "final ", "const ", "class ", "mixin ", "enum ", "extension ",
        "typedef ",
    ),
    "solidity": (
        "public ", "private ", "internal ", "external ", "pure ", "view ", "payable ", "virtual ", "override ", "function ",
        "modifier ", "event ", "error ", "struct ", "contract ", "interface ", "library ",
    ),
}
TAIL = "{;, \\t"


def _quoted(words: tuple[str, ...]) -> str:
    import re

    return "|".join(re.escape(w) for w in words)


def short_signature(signature: Column, language: Column) -> Column:
    """The signature without leading keywords of its language and without an opening brace at the end."""
    trimmed = F.trim(signature)
    out = trimmed
    for name, words in SIGNATURE_PREFIXES.items():
        out = F.when(language == name, F.regexp_replace(trimmed, f"^(?:{_quoted(words)})+", "")).otherwise(out)
    return F.regexp_replace(out, f"[{TAIL}]+$", "")


def byte_prefix(text: Column, cap: int) -> Column:
    """The longest start of at most cap UTF-8 bytes in whole characters."""
    raw = F.substring(F.encode(text, "utf-8"), 1, cap)
    # A character that was cut leaves a leading byte and fewer continuation bytes than it asks for.
    tail = F.hex(F.substring(raw, -4, 4))
    open_bytes = (
        F.when(tail.rlike("(C|D)[0-9A-F]$|^(C|D)[0-9A-F]$") & tail.rlike("(?:^|..)*(?:C|D).$"), 1)
        .when(tail.rlike("^(?:..)*E.$"), 1)
        .when(tail.rlike("^(?:..)*E.[89AB].$"), 2)
        .when(tail.rlike("^(?:..)*F.$"), 1)
        .when(tail.rlike("^(?:..)*F.[89AB].$"), 2)
        .when(tail.rlike("^(?:..)*F.[89AB].[89AB].$"), 3)
        .otherwise(0)
    )
    cut = F.octet_length(text) > cap
    whole = F.substring(raw, F.lit(1), F.octet_length(raw) - open_bytes)
    return F.when(cut, F.decode(whole, "utf-8")).otherwise(text)


def elapsed(seconds: Column) -> Column:
    """A duration as 's ago', 'm ago', 'h ago' or 'd ago'; 'never' for null."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(seconds.isNull(), "never").when(seconds < 60, part(1, "s")).when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))
    )
