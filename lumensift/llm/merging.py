"""Byte-pair merging of many words at once.

All words of a batch take their next merge together: the pair with the least rank, of equal ones the leftmost. Symbols lie place
by place, so that each step is a few passes over arrays. Pairs are looked up in an open-addressed table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import cached_property

import numpy as np

#: Words merged together; places that their symbols are rounded up to.
TOGETHER, WIDTHS = 40_000, (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)
_NONE = np.iinfo(np.int64).max


class PairTable:
    """rank << 32 | joined for each pair of symbols that may be merged."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, joined: np.ndarray):
        bits = max(12, int(4 * len(left)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        key, value = left.astype(np.int64) << 32 | right, rank.astype(np.int64) << 32 | joined
        slot, mask = self._slot(key), (1 << bits) - 1
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            put = self.keys[slot] == key
            self.values[slot[put]] = value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + 1) & mask
        self.mask = mask

    @cached_property
    def by_pair(self) -> dict[int, int]:
        used = self.keys != -1
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values of pairs; the largest number where there is none. Negative symbols have no pairs."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where((have == key) & (key >= 0), self.values[slot], _NONE)
        open_ = np.flatnonzero((have != key) & (have != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            have = self.keys[slot]
            hit = have == key[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (have != -1)
            open_, slot = open_[more], slot[more]
        out[right < 0] = _NONE
        return out


def table_of(tokenizer) -> tuple[dict[str, int], PairTable]:
    """The vocabulary and the merges of a BPE of the `tokenizers` library."""
    model = json.loads(tokenizer.to_str())["model"]
    vocabulary = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right = (np.array([vocabulary[m[i]] for m in merges], np.int64) for i in (0, 1))
    joined = np.array([vocabulary[a + b] for a, b in merges], np.int64)
    return vocabulary, PairTable(left, right, np.arange(len(merges)), joined)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def merged(symbols: np.ndarray, sizes: np.ndarray, table: PairTable, dropped: Callable[[np.ndarray, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after merging of words whose symbols lie one after another: flat, how many each word has, and how many merges were decided on.

    dropped(words, step), if given, says which of these words skip the merge that is their step-th decision."""
    starts = np.cumsum(sizes) - sizes
    left, decided = sizes.astype(np.int64).copy(), np.zeros(len(sizes), np.int64)
    out = symbols.astype(np.int32)
    low = 1
    for width in WIDTHS:
        chosen = np.flatnonzero((sizes > low) & (sizes <= width))
        low = max(low, width)
        some = max(1, TOGETHER * 8 // width)
        for a in range(0, len(chosen), some):
            _merge(out, starts, sizes, chosen[a : a + some], width, table, dropped, left, decided)
    for i in np.flatnonzero(sizes > low).tolist():
        _merge_long(out, int(starts[i]), int(sizes[i]), i, table, dropped, left, decided)
    ends = starts + left
    keep = np.zeros(len(out) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    return out[np.cumsum(keep[:-1]).astype(bool)], left, decided


def _merge(out: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, width: int, table: PairTable, dropped: Callable | None, left: np.ndarray, decided: np.ndarray) -> None:
    """Merges some words and puts the results where their symbols began."""
    first, size = starts[words], sizes[words]
    symbols = np.full((width + 1, len(words)), -1, np.int32)
    for i in range(width):
        inside = size > i
        symbols[i, inside] = out[first[inside] + i]
    values = table.find(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width, len(words))
    step = 0
    while True:
        best, at = values[0].copy(), np.zeros(len(words), np.int32)
        for i in range(1, width):
            less = values[i] < best
            np.copyto(best, values[i], where=less)
            np.copyto(at, i, where=less)
        going = best != _NONE
        if not going.all():
            done = ~going
            rest, n = symbols[:, done], size[done]
            left[words[done]], decided[words[done]] = n, step
            for i in range(int(n.max())):
                inside = n > i
                out[first[done][inside] + i] = rest[i, inside]
            if not going.any():
                return
            symbols, values = symbols[:, going], values[:, going]
            words, first, size, best, at = words[going], first[going], size[going], best[going], at[going]
        column = np.arange(len(words))
        if dropped is None:
            skip, merging = None, column
        else:
            skip = dropped(words, step)
            values[at[skip], column[skip]] = _NONE
            merging = np.flatnonzero(~skip)
        step += 1
        if not len(merging):
            continue
        place = at if skip is None else np.where(skip, width, at)
        symbols[at[merging], merging] = (best[merging] & 0xFFFFFFFF).astype(np.int32)
        for i in range(1, width):
            after = place < i
            np.copyto(symbols[i], symbols[i + 1], where=after)
            np.copyto(values[i - 1], values[i], where=place < i - 1) if i > 1 else None
        np.copyto(values[width - 1], _NONE, where=place < width)
        size = size - (place < width)
        x = at[merging]
        here = symbols[x, merging]
        values[x, merging] = table.find(here, symbols[x + 1, merging])
        inner = x > 0
        x, m, here = x[inner], merging[inner], here[inner]
        values[x - 1, m] = table.find(symbols[x - 1, m], here)


def _merge_long(out: np.ndarray, start: int, size: int, word: int, table: PairTable, dropped: Callable | None, left: np.ndarray, decided: np.ndarray) -> None:
    """The same for one long word, over an agenda, in n log n steps."""
    symbols, known = out[start : start + size].tolist(), table.by_pair
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def propose(a: int) -> None:
        if a >= 0 and (b := after[a]) < size and symbols[a] >= 0 and symbols[b] >= 0 and (value := known.get(symbols[a] << 32 | symbols[b])) is not None:
            heapq.heappush(agenda, (value, a, symbols[a], symbols[b]))

    for a in range(size - 1):
        propose(a)
    step, this = 0, np.array([word])
    while agenda:
        value, a, first, second = heapq.heappop(agenda)
        b = after[a]
        if symbols[a] != first or b >= size or symbols[b] != second:
            continue
        step += 1
        if dropped is not None and dropped(this, step - 1)[0]:
            continue
        symbols[a], symbols[b] = value & 0xFFFFFFFF, None
        after[a] = after[b]
        if after[a] < size:
            before[after[a]] = a
        propose(a)
        propose(before[a])
    rest = [s for s in symbols if s is not None]
    out[start : start + len(rest)] = rest
    left[word], decided[word] = len(rest), step
