"""Dictionaries of a worker: strings get numbers, and arrays kept one after another are taken by number."""

from __future__ import annotations

import numpy as np


class Numbered(dict):
    """A number for each string, from 0, in the order in which strings are first asked for. `new`: those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, string: str) -> int:
        self[string] = number = len(self)
        self.new.append(string)
        return number


def within(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Ragged:
    """Arrays of different lengths, kept in one that grows."""

    def __init__(self, kind: str):
        self.values, self.used = np.zeros(1024, kind), 0
        self.begin, self.size, self.rows = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Adds len(sizes) arrays, which `flat` holds one after another."""
        ends = self.used + np.cumsum(sizes, dtype=np.int64)
        self.values = _grown(self.values, self.used + len(flat))
        self.begin, self.size = (_grown(x, self.rows + len(sizes)) for x in (self.begin, self.size))
        self.values[self.used : self.used + len(flat)] = flat
        self.begin[self.rows : self.rows + len(sizes)], self.size[self.rows : self.rows + len(sizes)] = ends - sizes, sizes
        self.used, self.rows = self.used + len(flat), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers one after another, and their sizes."""
        sizes = self.size[rows].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.values[np.repeat(self.begin[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out
