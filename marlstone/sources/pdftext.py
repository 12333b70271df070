"""Text of PDF pages: content streams to positioned runs, runs to lines, lines to pages with a heading.

Covers uncompressed and deflated streams, literal and hexadecimal strings, and the text operators. Fonts are read in
the Windows-1252 encoding.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Geometry and heading rules.
LINE_DROP, WORD_GAP, SCRIPT_SIZE, SCRIPT_SHIFT = 0.3, 0.25, 0.8, 0.05
HEADING_RATIO, HEADING_BYTES, HEADING_LETTERS = 1.2, 120, 0.5
CHAR_WIDTH = 0.5

_TOKEN = re.compile(rb"\s*(?:(%[^\r\n]*)|(\()|<([0-9A-Fa-f\s]*)>|(\[)|(\])|(/[^\s()<>\[\]{}/%]*)|([+-]?(?:\d+\.?\d*|\.\d+))|([A-Za-z'\"*]+)|(<<|>>|.))", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal_string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening parenthesis ends at ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            nxt = data[at + 1 : at + 2]
            octal = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
            elif nxt in (b"\n", b"\r"):
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            else:
                out += _ESCAPES.get(nxt, nxt)
                at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes):
    """('string', bytes), ('number', float), ('op', str), ('name', str), ('open' or 'close', None)."""
    at = 0
    while (m := _TOKEN.match(data, at)) is not None and m.end() > at:
        at = m.end()
        if m[2]:
            value, at = literal_string(data, at)
            yield "string", value
        elif m[3] is not None:
            digits = re.sub(rb"\s", b"", m[3])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m[4]:
            yield "open", None
        elif m[5]:
            yield "close", None
        elif m[6]:
            yield "name", m[6].decode("latin-1")
        elif m[7]:
            yield "number", float(m[7])
        elif m[8]:
            yield "op", m[8].decode()


@dataclass
class Run:
    x: float
    y: float
    size: float
    text: str

    @property
    def end(self) -> float:
        return self.x + len(self.text) * self.size * CHAR_WIDTH


def decode(raw: bytes) -> str:
    return raw.decode("cp1252", "replace")


def runs(stream: bytes) -> list[Run]:
    """Positioned pieces of text of a content stream."""
    out: list[Run] = []
    stack: list = []
    scale, x, y, line_x, line_y, size, leading = 1.0, 0.0, 0.0, 0.0, 0.0, 12.0, 0.0
    array: list | None = None

    def show(raw: bytes) -> None:
        nonlocal x
        run = Run(x, y, size * scale, decode(raw))
        if run.text:
            out.append(run)
            x = run.end

    def move(dx: float, dy: float) -> None:
        nonlocal x, y, line_x, line_y
        line_x, line_y = line_x + dx * scale, line_y + dy * scale
        x, y = line_x, line_y

    for kind, value in tokens(stream):
        if kind == "open":
            array = []
        elif kind == "close":
            stack.append(array or [])
            array = None
        elif kind != "op":
            (stack if array is None else array).append(value)
        else:
            n = [v for v in stack if isinstance(v, float)]
            s = [v for v in stack if isinstance(v, bytes)]
            if value == "BT":
                scale, x, y, line_x, line_y = 1.0, 0.0, 0.0, 0.0, 0.0
            elif value == "Tf" and n:
                size = n[-1]
            elif value == "TL" and n:
                leading = n[-1]
            elif value == "Tm" and len(n) >= 6:
                scale = (n[-4] ** 2 + n[-3] ** 2) ** 0.5 or 1.0
                line_x, line_y = n[-2], n[-1]
                x, y = line_x, line_y
            elif value in ("Td", "TD") and len(n) >= 2:
                if value == "TD":
                    leading = -n[-1]
                move(n[-2], n[-1])
            elif value == "T*":
                move(0, -leading)
            elif value in ("'", '"'):
                move(0, -leading)
                for raw in s[-1:]:
                    show(raw)
            elif value == "Tj":
                for raw in s[-1:]:
                    show(raw)
            elif value == "TJ" and stack and isinstance(stack[-1], list):
                show(b"".join(v for v in stack[-1] if isinstance(v, bytes)))
            stack.clear()
    return out


def lines(found: list[Run]) -> list[tuple[str, float]]:
    """(text, greatest size) of the lines; smaller raised or lowered pieces are marked ^ or _."""
    out: list[tuple[str, float]] = []
    text, base = "", None
    for r in found:
        if base is not None:
            script = r.size < SCRIPT_SIZE * base.size and abs(r.y - base.y) > SCRIPT_SHIFT * base.size and abs(r.y - base.y) < base.size
            if not script and abs(base.y - r.y) > LINE_DROP * max(r.size, base.size):
                out.append((text.strip(), base.size))
                text, base = "", None
            else:
                if script:
                    text += "^" if r.y > base.y else "_"
                elif r.x - end > WORD_GAP * r.size and not text.endswith(" ") and not r.text.startswith(" "):
                    text += " "
        text += r.text
        end = r.end
        if base is None or r.size > base.size:
            base = r
    if base is not None:
        out.append((text.strip(), base.size))
    return [(t, s) for t, s in out if t]


def body_size(found: list[tuple[str, float]]) -> float | None:
    """The most frequent size, to a tenth; the smaller of equals."""
    counts = Counter(round(s, 1) for _, s in found)
    return min(counts, key=lambda s: (-counts[s], s)) if counts else None


def heading(found: list[tuple[str, float]]) -> str | None:
    """The first line that is much larger than the body, short, and mostly letters."""
    body = body_size(found)
    for text, size in found:
        raw = len(text.encode())
        if body and size >= HEADING_RATIO * body and raw <= HEADING_BYTES and sum(c.isalpha() for c in text) / raw >= HEADING_LETTERS:
            return text
    return None


def measure(pages: DataFrame, key: str) -> DataFrame:
    """(key, body, heading) of pages (key, lines: array of text and size): body_size() and heading() of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(x["text"], x["size"]) for x in page or []] for page in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([body_size(f) for f in found], pa.float64()), pa.array([heading(f) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "body", "heading"])

    return pages.select(key, "lines").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, body double, heading string")


def _streams(data: bytes) -> list[bytes]:
    """Content streams of the pages, in order of the file."""
    out = []
    for m in re.finditer(rb"<<((?:[^<>]|<[^<]|>[^>]|<<[^>]*>>)*)>>\s*stream\r?\n", data):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        if b"FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                continue
        if re.search(rb"\bBT\b", raw):
            out.append(raw)
    return out


def pages_text(data: bytes) -> list[tuple[str, str | None]]:
    """(text, heading) of each page. Raises ValueError for what is no PDF."""
    if not data.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    out = []
    for stream in _streams(data):
        found = lines(runs(stream))
        out.append(("\n".join(t for t, _ in found), heading(found)))
    return out


def matrix(rows: list[list[str]]) -> tuple[str, str]:
    """A matrix from its cells: as text with brackets, and as LaTeX."""
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    marks = [("[", "]")] if len(rows) == 1 else [("⎡", "⎤"), *[("⎢", "⎥")] * (len(rows) - 2), ("⎣", "⎦")]
    art = "\n".join(a + " ".join(c.rjust(w) for c, w in zip(r, widths, strict=True)) + b for r, (a, b) in zip(rows, marks, strict=True))
    return art, "\\begin{bmatrix} " + r" \\ ".join(" & ".join(r) for r in rows) + " \\end{bmatrix}"
