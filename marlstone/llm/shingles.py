"""Words, word shingles and their hashes in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd, so that its powers can be divided out.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Code points of texts that are taken at a time.
CHARS = 1 << 18
#: No letter or digit has a greater code point than this; it stands for all beyond.
_LAST = 0x3FFFF

_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """By code point whether it belongs to words (as in \\w), and a random value of its lower case."""
    if name not in _tables:
        points = range(_LAST + 1)
        _tables["word"] = np.fromiter((chr(c).isalnum() or c == 95 for c in points), dtype=bool, count=len(points))
        lower = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in points), dtype=np.uint64, count=len(points))
        _tables["value"] = mix(lower + np.uint64(0x5851F42D4C957F2D))
    return _tables[name]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse."""
    name = "inverse" if inverse else "power"
    if len(_tables.get(name, ())) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _INVERSE if inverse else _BASE)
        base[0] = 1
        _tables[name] = np.cumprod(base, dtype=np.uint64)
    return _tables[name][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which sequence_hashes() takes those of any run of values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def sequence_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs from starts to ends, whatever stands before them."""
    size = (ends - starts).astype(np.uint64)
    return mix((running[ends] - running[starts]) * powers(len(running), inverse=True)[starts] + size * _P[1])


class Tokens:
    """The words of some texts, one after the other: hashes of their lower case, and where each starts and ends.

    ``first`` has the first word of each text and, at last, the number of words; ``line`` numbers the lines of all
    texts; starts and ends are code points of the text itself.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        raw = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _LAST)
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = _table("word")[raw]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        self.hashes = sequence_hashes(sums(_table("value")[raw]), starts, ends)
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.first = np.searchsorted(starts, offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.starts, self.ends = starts - offsets[self.text], ends - offsets[self.text]
        self._newlines, self._at = np.flatnonzero(raw == 10), starts

    @property
    def line(self) -> np.ndarray:
        return np.searchsorted(self._newlines, self._at)


def portions(texts: list[str], most: int = CHARS):
    """Slices of the texts of about ``most`` code points, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def combine(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; a shorter text is one run of all its words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = (total ^ hashes[i : i + n]) * _P[i % 5] + (total >> np.uint64(29))
    return mix(total)

