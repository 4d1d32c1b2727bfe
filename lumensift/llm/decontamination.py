"""Benchmark passages in documents, by Wu-Manber search for many strings at once.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. Ten consecutive words of a benchmark item are a window; an item of
fewer words, but not of none, is one window. A word of a document is hit if it lies inside an occurrence of a window.

Texts and items become words with one space before and after each, so a window's occurrences are those of its bytes. Windows are searched by classes of
length. For each class a table has for every block of a few bytes how far the search may move on, and where it may not, the windows whose beginnings end with that
block are compared byte by byte. A block of texts is searched from many places at the same time.

Windows go to the tasks by broadcast in portions of PORTION bytes of items at most (an item longer than a segment is cut into segments that share nine words). Where all
fit into one, nothing is shuffled; else each portion is a pass over the documents, and what the passes found is joined by row.

Null text: no words. Null doc_id, repeated rows: each row is judged by itself. A null item_id counts as an item named `null`; items with one item_id, or without, are one item. Very long texts: a
block of their own. No items, or none with words: nothing is hit. Empty table: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import slices, texts, written
from lumensift.llm.numbered import within

#: Words of a window; bytes of items that are broadcast together; bytes of a segment of a long item; bytes of text searched together, and of the stretch that a place starts from.
WINDOW, PORTION, SEGMENT, BLOCK, STRETCH = 10, 8_000_000, 1_000_000, 2_000_000, 256
_SPACE, _END = 32, 10
#: Word bytes as they are searched, others as spaces. Bytes from 128 on are parts of characters beyond ASCII.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Some texts as words with single spaces, one after another: ` one two \\n three \\n`."""

    def __init__(self, column: pa.Array):
        raw = b"".join([b" ", pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(pa.binary())), b" \n ")[0].as_py(), b" \n"])
        flat = np.frombuffer(raw.translate(_BYTES), np.uint8).copy()
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        flat[np.cumsum(sizes + 3) - 1] = _END
        space = flat == _SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] = True
        flat = flat[keep]
        self.size = len(flat)
        self.bytes = np.concatenate([flat, np.zeros(16, np.uint8)])
        gap = (flat == _SPACE) | (flat == _END)
        #: Where the space before each word is, and the text that each word is in.
        self.starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.flatnonzero(flat == _END)
        before = np.searchsorted(self.starts, ends)
        self.counts = np.diff(before, prepend=0)
        self.firsts = before - self.counts

    @cached_property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _eight(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))


def _mask(n: np.ndarray) -> np.ndarray:
    """Of a number of eight bytes the first n, 1 at least."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(n, 8).astype(np.uint64) * np.uint64(8))


class _Class:
    """The tables of windows of similar length: how far to move on by the block of bytes at the end, and the windows to compare."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray):
        self.least = int(size.min())
        self.block = min(8, self.least)
        self.mask = _mask(np.array(self.block))
        first = self.least - self.block
        bits = min(24, max(12, int(4 * min(len(start) * (first + 1), len(flat))).bit_length()))
        self.shift_by = np.uint64(64 - bits)
        self.moves = np.full(1 << bits, min(first + 1, 255), np.uint8)
        eight = _eight(flat)
        for place in range(first + 1):  # the later a block stands, the less may be skipped
            hashes = self.hashed(eight[start + place])
            self.moves[hashes] = min(first - place, 255)
        order = np.argsort(hashes, kind="stable")
        self.start, self.size, self.number, self.hashes = start[order], size[order], number[order], hashes[order]
        self.at = first

    def hashed(self, eight: np.ndarray) -> np.ndarray:
        x = (eight & self.mask) * _MIX
        return ((x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift_by).astype(np.int64)

    def found(self, text: Words, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text where a window occurs, and the window's number."""
        eight, own = _eight(text.bytes), _eight(flat)
        last = text.size - self.least
        at = np.arange(0, last + 1, STRETCH)
        stop = np.minimum(at + STRETCH, last + 1)
        places, windows = [], []
        while len(at):
            hashes = self.hashed(eight[at + self.at])
            move = self.moves[hashes]
            hit = np.flatnonzero(move == 0)
            if len(hit):
                low, high = np.searchsorted(self.hashes, hashes[hit]), np.searchsorted(self.hashes, hashes[hit], side="right")
                many = high - low
                place, row = np.repeat(at[hit], many), np.repeat(low, many) + within(many)
                same = self._equal(eight, own, place, row)
                places.append(place[same])
                windows.append(self.number[row[same]])
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return (np.concatenate(places), np.concatenate(windows)) if places else (np.zeros(0, np.int64),) * 2

    def _equal(self, eight: np.ndarray, own: np.ndarray, place: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which windows stand at these places, compared byte by byte, eight at a time."""
        open_, offset = np.arange(len(place)), 0
        kept = np.zeros(len(place), bool)
        while len(open_):
            rest = self.size[row[open_]] - offset
            differ = (eight[place[open_] + offset] ^ own[self.start[row[open_]] + offset]) & _mask(rest)
            open_, rest = open_[differ == 0], rest[differ == 0]
            kept[open_[rest <= 8]] = True
            open_, offset = open_[rest > 8], offset + 8
        return kept


class Windows:
    """The windows of some segments of items."""

    def __init__(self, segments: list[tuple[str | None, str, bool]]):
        """segments: item, words, and whether it is a whole item (else one of less than ten words has no window)."""
        items = sorted({"null" if i is None else i for i, _, _ in segments})
        number_of = {name: k for k, name in enumerate(items)}
        self.items = items
        text = Words(pa.array([t for _, t, _ in segments], pa.string()))
        self.flat = text.bytes
        whole = np.array([w for _, _, w in segments], bool)
        n = np.where(text.counts >= WINDOW, text.counts - WINDOW + 1, np.where(whole & (text.counts > 0), 1, 0))
        words = np.minimum(np.repeat(text.counts, n), WINDOW)
        first = np.repeat(text.firsts, n) + within(n)
        item = np.repeat(np.array([number_of["null" if i is None else i] for i, _, _ in segments], np.int64), n)
        start = text.starts[first]
        ends = np.append(np.flatnonzero(self.flat[: text.size] == _END), text.size)
        end = np.minimum(np.append(text.starts, text.size)[first + words] + 1, ends[np.searchsorted(ends, start)])  # with the space after the last word
        size = end - start
        raw = self.flat.tobytes()
        #: Equal windows are one, with all their items.
        numbers: dict[bytes, int] = {}
        number = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        kept, first_of = np.unique(number, return_index=True)
        self.words = words[first_of]
        order = np.lexsort((item, number))
        pair = np.stack([number[order], item[order]])
        pair = pair[:, np.flatnonzero(np.any(np.diff(pair, prepend=-1), axis=0))]
        self.item, self.begin = pair[1], np.searchsorted(pair[0], np.arange(len(kept) + 1))
        start, size = start[first_of], size[first_of]
        kinds = np.minimum(np.floor(np.log2(size)), 6).astype(int) if len(size) else size
        self.classes = [_Class(self.flat, *(x[kinds == k] for x in (start, size, kept))) for k in np.unique(kinds)]

    def hits(self, text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each occurrence its first word, the number of its words, and its window."""
        found = [c.found(text, self.flat) for c in self.classes]
        place, window = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return np.searchsorted(text.starts, place), self.words[window], window

    def items_of(self, text: Words, first: np.ndarray, window: np.ndarray) -> list[tuple[int, list[str]]]:
        """Texts with occurrences, and the items of these."""
        pairs = np.unique(text.text_of[first] << 32 | window)
        document, window = pairs >> 32, pairs & 0xFFFFFFFF
        many = self.begin[window + 1] - self.begin[window]
        pairs = np.unique(np.repeat(document, many) << 32 | self.item[np.repeat(self.begin[window], many) + within(many)])
        out: dict[int, list[str]] = {}
        for d, i in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
            out.setdefault(d, []).append(self.items[i])
        return list(out.items())


def _covered(first: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of these runs."""
    edges = np.bincount(first, minlength=n + 1) - np.bincount(first + words, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judge(batches: Iterator[pa.RecordBatch], windows: Broadcast) -> Iterator[pa.RecordBatch]:
    """RESULT, where all windows are in one portion."""
    for batch in batches:
        for block in slices(batch, limit=BLOCK):
            text = Words(block.column(1))
            first, words, window = windows.value.hits(text)
            hit = np.bincount(text.text_of[_covered(first, words, len(text.starts))], minlength=block.num_rows)
            n_items, digests = np.zeros(block.num_rows, np.int64), [_digest([])] * block.num_rows
            for d, items in windows.value.items_of(text, first, window):
                n_items[d], digests[d] = len(items), _digest(items)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(text.counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(n_items), pa.array(digests, pa.string()), pa.array(hit > 0)], [c.split(" ")[0] for c in RESULT.split(", ")])


_FOUND = "row long, runs array<long>, items array<string>"


def _find(batches: Iterator[pa.RecordBatch], windows: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of rows (row, text) those with occurrences of one portion's windows: runs of hit words (first and number, in turn), and items."""
    for batch in batches:
        for block in slices(batch, limit=BLOCK):
            text, rows, runs, items = Words(block.column(1)), [], [], []
            first, words, window = windows.value.hits(text)
            covered = _covered(first, words, len(text.starts))
            for d, names in windows.value.items_of(text, first, window):
                a = int(text.firsts[d])
                edges = np.flatnonzero(np.diff(covered[a : a + int(text.counts[d])].astype(np.int8), prepend=0, append=0))
                rows.append(block.column(0)[d])
                runs.append(np.stack([edges[::2], edges[1::2] - edges[::2]], 1).ravel())
                items.append(names)
            yield pa.RecordBatch.from_arrays([pa.array([r.as_py() for r in rows], pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["row", "runs", "items"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as words, long ones in segments with nine words of the next. Rows (item, words, whole, size)."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = Words(batch.column(1).slice(i, 1))
            n, raw, out = len(text.starts), text.bytes[: text.size].tobytes(), []
            ends = np.append(text.starts[1:], text.size - 1 if n else 0)
            a = 0
            while a < n:
                b = max(min(a + WINDOW, n), int(np.searchsorted(ends, text.starts[a] + SEGMENT)))
                out.append(raw[text.starts[a] : ends[b - 1]].decode("utf-8", "replace"))
                if b >= n:
                    break
                a = b - WINDOW + 1
            m = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * m, pa.string()), pa.array(out, pa.string()), pa.array([m == 1] * m, pa.bool_()), pa.array(map(len, out), pa.int64())], ["item", "words", "whole", "size"])


def contamination(docs: DataFrame, benchmark: DataFrame, portion: int = PORTION) -> DataFrame:
    """RESULT for each row of docs(doc_id, text, ...), held against benchmark(item_id, text, ...)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    segments = items.mapInArrow(_segments, "item string, words string, whole boolean, size long")
    total, n = segments.agg(F.sum("size"), F.count("*")).first()
    total = (total or 0) + 64 * n
    if total <= portion:
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in segments.select("item", "words", "whole").collect()]))
        return texts(docs).mapInArrow(lambda batches: _judge(batches, windows), RESULT)
    portions = math.ceil(2 * total / portion)  # by hash, so one may have twice as much as the mean
    segments = written(segments.withColumn("portion", F.pmod(F.xxhash64("item", "words"), F.lit(portions))))
    rows = written(texts(docs, F.monotonically_increasing_id().alias("row")))
    found = None
    for k in range(portions):
        own = segments.where(F.col("portion") == k).select("item", "words", "whole").collect()
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in own]))
        more = written(rows.select("row", "text").mapInArrow(lambda batches, w=windows: _find(batches, w), _FOUND))
        windows.unpersist()
        found = found.union(more) if found else more
    return _merged(rows, found)


def _merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """RESULT of rows(doc_id, text, row) and what several portions found in them."""
    merged = found.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = rows.select("doc_id", "row", "text").mapInArrow(_counted, "doc_id long, row long, n_words long").join(merged, "row", "left")
    # runs by their beginnings; each adds what lies behind the furthest end so far
    runs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(F.get("runs", 2 * i).alias("a"), F.get("runs", 2 * i + 1).alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))
    step = lambda s, r: F.struct((s["sum"] + F.greatest(F.lit(0).cast("long"), r["a"] + r["n"] - F.greatest(r["a"], s["end"]))).alias("sum"), F.greatest(s["end"], r["a"] + r["n"]).alias("end"))
    hit = F.when(F.col("runs").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(runs, start, step)["sum"])
    names = F.coalesce("items", F.array().cast("array<string>"))
    return counted.select("doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in slices(batch, 2, BLOCK):
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(Words(block.column(2)).counts, pa.int64())], ["doc_id", "row", "n_words"])
