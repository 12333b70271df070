"""Splitting of long texts: fragments between ever finer separators, or the nodes of a syntax tree, grouped at least cost.

A text is cut at its coarsest separators first; a fragment that is still too large is cut at the next finer ones. For
Python sources the fragments are nodes of the syntax tree, with separators between and inside them. Everything about the
fragments is kept in arrays by fragment: byte offsets, the level of the boundary before each (the coarsest separator or
syntax level that parts it from the one before), and the greatest line break inside and before it.

A passage is a run of fragments. ``least[i]`` is the least cost to cover the first i fragments; passages that end with
fragment i are judged all at once, as arrays over their first fragments. The plan before a passage may reach into it by
the overlap: whenever a plan is ready, it is offered to the passages whose start it reaches, so that each start knows the
best plan before it.

All offsets are UTF-8 bytes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators from coarse to fine, and costs.
SEPARATORS = (
    r"\n\n+",
    r"\n",
    r"[\.\?!]\s+|。|？|！",
    r"[;:\-—]\s+|；|：|—+",
    r",\s+|，",
    r"\s+",
)
SYNTAX_GAP = 512
MISSING_OVERLAP = 512
PER_LINE_BREAK = 64
TOO_SMALL = 1_048_576
MIN_CHUNK_FLOOR = 512
OVERLAP = 200

_PATTERNS = [re.compile(s) for s in SEPARATORS]
_SPACES = np.array([*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
_DEEPEST = 256
_MATRIX = 1 << 21  # costs held at a time
_TEXT = 1 << 20  # bytes of text cut before their passages are handed on
#: Cost of a boundary that is so many levels finer than the coarsest one inside.
_GAP_COST = np.concatenate([[0], np.cumsum(SYNTAX_GAP // np.arange(1, 2 * _DEEPEST))])


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    start_line: int
    end_line: int


@dataclass(frozen=True)
class Fragments:
    """Trimmed fragments of a text in order; the boundary after the last has level 0 and a blank line."""

    start: np.ndarray
    end: np.ndarray
    level: np.ndarray
    inside: np.ndarray
    before: np.ndarray


def byte_offsets(points: np.ndarray) -> np.ndarray:
    """The byte offset of each code point and of the end."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(size)])


def _separated(text: str, at: np.ndarray, lo: int, hi: int, most: int, level: int, base: int) -> list[tuple[int, int, int]]:
    """(start, end, level of the boundary before) of the fragments between separators; the first has the given level."""
    parts = [(lo, hi, level)]
    for depth, pattern in enumerate(_PATTERNS):
        if all(at[b] - at[a] <= most for a, b, _ in parts):
            break
        finer = []
        for a, b, own in parts:
            if at[b] - at[a] <= most:
                finer.append((a, b, own))
                continue
            spans = [m.span() for m in pattern.finditer(text, a, b)]
            edges = [a, *[e for _, e in spans]], [*[s for s, _ in spans], b]
            finer += [(x, y, own if k == 0 else base + depth + 2) for k, (x, y) in enumerate(zip(*edges, strict=True))]
        parts = finer
    return parts


def _tree(text: str) -> tuple[ast.AST, int] | None:
    """The syntax tree of Python source, and the number of lines put before an indented one; None if it is none."""
    for head in ("", "if 1:\n"):
        try:
            return ast.parse(head + text), head.count("\n")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    return None


def _by_syntax(text: str, points: np.ndarray, at: np.ndarray, most: int) -> list[tuple[int, int, int]] | None:
    """Fragments along the nodes of the syntax tree; string and number literals are not cut."""
    found = _tree(text)
    if found is None:
        return None
    tree, lines_before = found
    line_starts = np.concatenate([[0], at[np.flatnonzero(points == 10) + 1]])

    def place(line: int, column: int) -> int:
        return int(np.searchsorted(at, line_starts[line - 1 - lines_before] + column))

    def children(node: ast.AST) -> list[tuple[int, int, ast.AST]]:
        spans = []
        for child in ast.iter_child_nodes(node):
            if getattr(child, "end_lineno", None) is None or child.lineno <= lines_before:
                spans += children(child)
            else:
                first = min([child, *getattr(child, "decorator_list", [])], key=lambda n: (n.lineno, n.col_offset))
                spans.append((place(first.lineno, first.col_offset), place(child.end_lineno, child.end_col_offset), child))
        return sorted(spans, key=lambda s: s[:2])

    out: list[tuple[int, int, int]] = []
    waiting = [(0, len(text), 0, 0, tree)]  # in order: start, end, level before, depth, node or None for a gap
    while waiting:
        lo, hi, level, depth, node = waiting.pop()
        if node is not None and (at[hi] - at[lo] <= most or isinstance(node, ast.Constant | ast.JoinedStr)):
            out.append((lo, hi, level))
            continue
        inner = children(node) if node is not None and depth < _DEEPEST - 16 else []
        if not inner:
            out += _separated(text, at, lo, hi, most, level, depth)
            continue
        parts, here = [], lo
        for a, b, child in inner:
            if a < here:  # a child that shares its place with one before it
                continue
            if a > here:
                parts.append((here, a, None))
            parts.append((a, b, child))
            here = b
        if here < hi:
            parts.append((here, hi, None))
        waiting += [(a, b, level if k == 0 else depth + 1, depth + 1 if child is not None else depth, child) for k, (a, b, child) in reversed(list(enumerate(parts)))]
    return out


def fragments(text: str, most: int, language: str | None = None) -> Fragments:
    """The fragments of at most ``most`` bytes where the separators allow it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = byte_offsets(points)
    parts = _by_syntax(text, points, at, most) if language == "python" else None
    if parts is None:
        parts = _separated(text, at, 0, len(text), most, 0, 0)
    lo, hi, level = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
    solid = np.flatnonzero(~np.isin(points, _SPACES))
    first, last = np.searchsorted(solid, lo), np.searchsorted(solid, hi)
    full = first < last
    if not full.any():
        return Fragments(*[np.empty(0, np.int64)] * 5)
    # Of the boundaries around blank fragments the coarsest counts.
    kept = np.flatnonzero(full)
    level = np.minimum.reduceat(level[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
    left, right = solid[first[full]], solid[last[full] - 1] + 1
    behind = np.concatenate([[0], right[:-1]])
    newline = (points == 10) | (points == 13)
    ends = np.concatenate([[0], np.cumsum(newline)])
    twice = np.concatenate([[0], np.cumsum(newline[:-1] & (points[:-1] == points[1:])), [0]])
    breaks = lambda a, b: np.where(b > a, np.where(twice[np.maximum(b - 1, 0)] > twice[a], 2, np.minimum(ends[b] - ends[a], 1)), 0)
    before = breaks(behind, left)
    # A fragment on a new line takes its indentation along.
    plain = np.concatenate([[-1], np.flatnonzero((points != 32) & (points != 9))])
    indented = np.maximum(plain[np.searchsorted(plain, left) - 1] + 1, behind)
    begin = np.where(before > 0, indented, left)
    return Fragments(at[begin], at[right], np.minimum(level, _DEEPEST), breaks(left, right), before)


def _own_costs(parts: Fragments, lowest: np.ndarray, block: slice, chunk_size: int, overlap: int, min_chunk: int) -> np.ndarray:
    """(fragments of the block, k): what a passage that ends with the fragment and has k more before it costs by itself."""
    ends = np.arange(block.start, block.stop)
    wide = int((ends - lowest[block]).max()) + 1
    level_after, break_after = np.append(parts.level[1:], 0)[block], np.append(parts.before[1:], 2)[block]
    # The coarsest boundary and the greatest line break among the fragments after the passage's first.
    coarsest, widest = np.full(len(ends), 2 * _DEEPEST), np.zeros(len(ends), dtype=np.int64)
    out = np.full((len(ends), wide), MISSING_OVERLAP if overlap else MISSING_OVERLAP // 2)
    for k in range(wide):
        at = np.maximum(ends - k, 0)
        level, size = parts.level[at], parts.end[block] - parts.start[at]
        out[:, k] += _GAP_COST[np.maximum(level - coarsest, 0)] + _GAP_COST[np.maximum(level_after - coarsest, 0)]
        out[:, k] += PER_LINE_BREAK * (np.maximum(widest - parts.before[at], 0) + np.maximum(widest - break_after, 0))
        out[:, k] += TOO_SMALL * (size < min_chunk)
        coarsest, widest = np.minimum(coarsest, level), np.maximum(widest, parts.inside[at])
    return out


def grouped(parts: Fragments, total: int, chunk_size: int, overlap: int, min_chunk: int) -> list[tuple[int, int]]:
    """The cheapest passages as (start, end) bytes."""
    n = len(parts.start)
    if not n:
        return []
    start, end = parts.start, parts.end
    rest = lambda offsets: (total - offsets) * MISSING_OVERLAP // overlap if overlap else np.zeros_like(offsets)
    rest_start, rest_end = rest(start), np.concatenate([rest(np.zeros(1, np.int64)), rest(end)]).tolist()
    # The first fragment of the longest passage that ends with each, and the first start that the plan before each may reach.
    lowest = np.minimum(np.searchsorted(start, end - chunk_size, "left"), np.arange(n))
    reached = np.minimum(np.searchsorted(start, end - overlap, "left"), np.arange(n)).tolist()
    alone = (end - start > chunk_size).tolist()
    least, first, prior = [0], [0], [0]
    # By start: the value of the best plan before it, that plan, and what the plan adds to a passage from there.
    offer, offered, added = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64)
    rows = max(1, _MATRIX // (int((np.arange(n) - lowest).max()) + 1))
    for low in range(0, n, rows):
        own = _own_costs(parts, lowest, slice(low, min(low + rows, n)), chunk_size, overlap, min_chunk)
        for i in range(low, min(low + rows, n)):
            value = least[i] + rest_end[i]
            if overlap and reached[i] < i:
                better = np.flatnonzero(offer[reached[i] : i] >= value) + reached[i]
                offer[better], offered[better] = value, i
                added[better] = least[i] + np.minimum(rest_end[i] - rest_start[better], 0)
            offer[i], added[i] = value, least[i] + (min(rest_end[i] - int(rest_start[i]), 0) if overlap else 0)
            if alone[i]:
                cost, s, plan = int(own[i - low, 0]) - (MISSING_OVERLAP if overlap else MISSING_OVERLAP // 2) + least[i], i, i
            else:
                tried = own[i - low, : i - lowest[i] + 1] + added[lowest[i] : i + 1][::-1]
                k = int(tried.argmin())
                cost, s = int(tried[k]), i - k
                plan = int(offered[s])
            least.append(cost)
            first.append(s)
            prior.append(plan)
    out, at = [], n
    while at:
        out.append((int(start[first[at]]), int(end[at - 1])))
        at = prior[at]
    return out[::-1]


def split(text: str, chunk_size: int, overlap: int, min_chunk: int, language: str | None = None) -> list[Piece]:
    """Passages of at most chunk_size bytes (but for single fragments), with 1-based lines."""
    overlap = min(overlap, min_chunk)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found = grouped(fragments(text, overlap or min_chunk, language), len(data), chunk_size, overlap, min_chunk)
    newlines = np.flatnonzero(data == 10)
    line = lambda offset: 1 + int(np.searchsorted(newlines, offset))
    return [Piece(s, e, line(s), line(e)) for s, e in found]


def sizing(body_bytes: int, max_tokens: int, bytes_per_token: int) -> tuple[int, int] | None:
    """(chunk size, least size) if a body of that many bytes is to be split."""
    limit = max_tokens * bytes_per_token
    if body_bytes <= max_tokens or body_bytes <= limit:
        return None
    return max(limit, MIN_CHUNK_FLOOR + 1), max(max_tokens // 2 * bytes_per_token, MIN_CHUNK_FLOOR)


def needs_split(body, max_tokens: int, bytes_per_token: int):
    """The same decision as a column."""
    return F.octet_length(body) > F.lit(max_tokens * max(bytes_per_token, 1))


_PIECE = T.StructType([T.StructField("content", T.StringType()), T.StructField("l0", T.LongType()), T.StructField("l1", T.LongType())])


def _parts(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``_TEXT`` bytes of text, or of one row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, before + _TEXT, "right")) - at)
        yield batch.slice(at, n)
        at += n


def split_chunks(chunks: DataFrame, max_tokens: int, bytes_per_token: int, overlap: int = OVERLAP) -> DataFrame:
    """Rows whose content is too large become several: sub_chunk_idx, total_sub_chunks, strategy 1, lines offset by the parent's."""
    fields = {f.name: f for f in chunks.schema.fields}
    chunk_size = max(max_tokens * bytes_per_token, MIN_CHUNK_FLOOR + 1)
    least = max(max_tokens // 2 * bytes_per_token, MIN_CHUNK_FLOOR)

    kept = [n for n in fields if n != "content"]  # whole texts need not come back beside their pieces
    cut_schema = T.StructType([*[fields[n] for n in kept], T.StructField("m_pieces", T.ArrayType(_PIECE))])
    has_language = "language" in fields

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("content", pa.string()), ("l0", pa.int64()), ("l1", pa.int64())]))
        for batch in batches:
            for part in _parts(batch, batch.column("content")):
                bodies = part.column("content").to_pylist()
                languages = part.column("language").to_pylist() if has_language else [None] * len(bodies)
                out = []
                for body, language in zip(bodies, languages, strict=True):
                    data = body.encode("utf-8", "surrogatepass")
                    found = split(body, chunk_size, overlap, least, language)
                    out.append([{"content": data[p.start : p.end].decode("utf-8", "replace"), "l0": p.start_line, "l1": p.end_line} for p in found])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], pa.array(out, kind)], [*kept, "m_pieces"])

    large = needs_split(F.col("content"), max_tokens, bytes_per_token)
    whole = chunks.where(~large | F.col("content").isNull())
    cut = chunks.where(large).mapInArrow(pieces, cut_schema).select("*", F.posexplode("m_pieces").alias("m_i", "m_p"))
    replaced = {
        "content": F.col("m_p.content"),
        "end_line": F.col("start_line") + F.col("m_p.l1") - 1,
        "start_line": F.col("start_line") + F.col("m_p.l0") - 1,
        "sub_chunk_idx": F.col("m_i").cast("long"),
        "total_sub_chunks": F.size("m_pieces").cast("long"),
        "chunk_strategy": F.lit(1),
    }
    return whole.unionByName(cut.select(*[(replaced[n].cast(f.dataType) if n in replaced else F.col(n)).alias(n) for n, f in fields.items()]))
