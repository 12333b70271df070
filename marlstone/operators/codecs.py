"""Codes of vectors inside an index's cells: a byte per coordinate, or a byte per group of coordinates."""

from __future__ import annotations

import numpy as np

LEVELS = 256


class ScalarCodec:
    """Each coordinate as one of 256 even steps between the least and the greatest of the sample."""

    def __init__(self, sample: np.ndarray):
        self.low = sample.min(axis=0)
        self.step = np.maximum((sample.max(axis=0) - self.low) / (LEVELS - 1), 1e-12)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((rows - self.low) / self.step), 0, LEVELS - 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes * self.step + self.low


class ProductCodec:
    """Each group of coordinates as the nearest of its own 256 centroids, fitted on the sample."""

    def __init__(self, sample: np.ndarray, groups: int, rounds: int = 8, seed: int = 42):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.edges = [(g * width // groups, (g + 1) * width // groups) for g in range(groups)]
        self.books = []
        for a, b in self.edges:
            x = sample[:, a:b]
            book = x[rng.choice(len(x), min(LEVELS, len(x)), replace=False)].copy()
            for _ in range(rounds):
                nearest = self._nearest(x, book)
                counts = np.bincount(nearest, minlength=len(book))
                sums = np.zeros_like(book)
                np.add.at(sums, nearest, x)
                book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
            self.books.append(book)

    @staticmethod
    def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book * book).sum(axis=1) - 2 * rows @ book.T).argmin(axis=1)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([self._nearest(rows[:, a:b], book) for (a, b), book in zip(self.edges, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, g]] for g, book in enumerate(self.books)], axis=1)
