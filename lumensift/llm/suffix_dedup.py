"""Exact-substring deduplication over a suffix array.

A byte is removed if a string of `least` bytes (50) that covers it also starts in a document with a smaller doc_id.
Strings lie within documents and are judged on the input.

The suffix array is built by two-stage sorting: suffixes that are smaller than their successors are sorted directly, the
rest are induced by scans over the buckets of first bytes; then common prefixes of neighbours say which strings are equal.

It is distributed by minimizers. Of each 50-byte window the K-byte substring with the least hash is its anchor, so equal
windows have equal anchors, and about every (50 - K) / 2 bytes there is one.

1. Equal texts are found by digest; the row with the smallest doc_id stands for them. The others lose everything.
2. Anchors (48-bit hash, doc_id) are dealt by hash. Those of at least two documents come back as candidates, by doc_id.
3. Each run of windows with the same candidate anchor is sent, as one string, to the anchor's bucket. Equal strings are
   merged; a suffix array over the others finds equal windows and the smallest doc_id of each.
4. Spans to remove go back to their documents.

Hashes only choose what meets; whether strings are equal is read from the suffix array, whose text they are.

Keys with very many rows: of the rows of a block that have an anchor, or a string, only those with the extreme ids go to its bucket, as the
others follow; so a line that all documents have sends a row for a block, not for a document. Copies are salted.

Null text: empty, nothing removed. Null doc_id: larger than all others (as is one within 2**40 of the largest long), and none of them smaller than another.
Rows that repeat a doc_id do not affect each other; each is judged against smaller ids. Texts of one id are told apart by 64 bits of their SHA-256.
Very long texts: anchors are sought in overlapping stretches. Empty table: no rows. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.llm.common import blocks, partitions, quoted

#: Bytes of an anchor; input bytes to a bucket; least and most bits of a bucket's number; bytes of a suffix array, unless one anchor has more.
K, BUCKET_BYTES, BITS, ARRAY_BYTES = 24, 8_000_000, (4, 28), 2_000_000
#: Bits of a position in a stretch that anchors are sought in; longer blocks are cut.
POSITION = 24
#: Characters handled together while anchors are sought.
BLOCK = 2_000_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Ids from here on stand for null, with a hash of the text in the low bits, so that such rows spread; none of them is smaller than another.
NULLS = (1 << 63) - (1 << 40)
#: Ways that the rows of one text are dealt.
SALTS = 16
RUN = np.dtype([("doc_id", "<i8"), ("check", "<i8"), ("start", "<u4"), ("anchor", "<u4"), ("length", "u1")])
MARK = np.dtype([("id", "<i8"), ("check", "<i8"), ("span", "<i8")])


def hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of data[i : i + k] for each i; of the last k - 1 positions, anything."""

    def after(x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([x[n:], np.zeros(min(n, len(x)), np.uint64)])

    piece, width, power = data.astype(np.uint64) + np.uint64(1), 1, _ODD
    total, done = np.zeros(len(data), np.uint64), 0
    while True:
        if k & width:
            total = total * power + after(piece, done)
            done += width
        if 2 * width > k:
            break
        piece = piece * power + after(piece, width)
        width, power = 2 * width, np.uint64(int(power) ** 2 & (1 << 64) - 1)
    total = (total ^ (total >> np.uint64(31))) * _MIX
    return (total ^ (total >> np.uint64(29))) * _ODD


def least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The least of x[i : i + n]; near the end of what is there."""
    have = 1
    while have < n:
        step = min(have, n - have)
        y = x.copy()
        np.minimum(x[: max(0, len(x) - step)], x[step:], out=y[: max(0, len(x) - step)])
        x, have = y, have + step
    return x


def runs(data: np.ndarray, bounds: np.ndarray, least: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and hash of the anchor of each run of windows with one anchor. bounds: where documents begin, then the end."""
    n = len(data)
    valid = np.ones(n + 1, np.int8)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(bounds[:-1], bounds[1:] - least + 1), 1)
    np.add.at(edge, bounds[1:], -1)
    valid = np.append(np.cumsum(edge[:n]) == 0, False)
    h = hashes(data, k)
    low = np.uint64((1 << POSITION) - 1)
    anchor = np.empty(n, np.int64)
    step = (1 << POSITION) - least + 1
    for a in range(0, n, step):  # stretches overlap, so that each window lies in one
        part = h[a : a + step + least - 1]
        found = least_ahead(part & ~low | np.arange(len(part), dtype=np.uint64), least - k + 1) & low
        anchor[a : a + step] = found[:step].astype(np.int64) + a
    begins = valid[:n].copy()
    begins[1:] &= ~valid[: n - 1] | (anchor[1:] != anchor[:-1])
    ends = valid[:n].copy()
    ends[:-1] &= ~valid[1:n] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(begins)
    chosen = h[anchor[first]]  # least of many, so small; mixed again, to fill the buckets evenly
    chosen = (chosen ^ (chosen >> np.uint64(32))) * _MIX
    return first, np.flatnonzero(ends) + 1 - first, chosen ^ (chosen >> np.uint64(29))


def joined(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [s.encode("utf-8", "surrogatepass") for s in strings]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)


def _by_bucket(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash, the buckets that occur, and where each begins (then the end)."""
    order = np.argsort(h, kind="stable")
    bucket = (h[order] >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]) if len(h) else np.zeros(0, np.int64)
    return order, bucket[cut], np.append(cut, len(h))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The `width` low bytes of integers, byte by byte, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def _from_planes(blob: memoryview, n: int, width: int, kind: str) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width).reshape(width, n).T
    return out.view(kind).ravel()


def anchors(block: pa.RecordBatch, strings: list[str], least: int, bits: int) -> pa.RecordBatch:
    """A row for each bucket: 48 bits of the hashes and the doc_ids of a block's different anchors. Of an anchor that several ids of the block
    have, the bucket gets the least and the greatest id alone; the others are known to share it, and are in a row with a negative number."""
    data, bounds = joined(strings)
    first, _, h = runs(data, bounds, least) if len(data) else (np.zeros(0, np.int64), None, np.zeros(0, np.uint64))
    ids = block.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(bounds, first, side="right") - 1]
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
    h, ids = h[new], ids[new]
    begins = np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
    ends = np.concatenate([begins[1:], np.ones(min(1, len(h)), bool)])
    known = np.zeros(len(h), bool)
    if len(h):
        at, known_ids = np.flatnonzero(begins), np.minimum(ids, NULLS)
        known = np.repeat(known_ids[at] < known_ids[np.flatnonzero(ends)], np.diff(np.append(at, len(h)))) & ~begins & ~ends
    blobs, named = [], []
    if known.any():
        named.append(-1 - int(ids[0]) % 997)
        blobs.append(_planes(h[known], 6) + _planes(ids[known], 8))
        h, ids = h[~known], ids[~known]
    _, buckets, cuts = _by_bucket(h, bits)
    for a, b in zip(cuts, cuts[1:], strict=False):
        blobs.append(_planes(h[a:b], 6) + _planes(ids[a:b], 8))
    return pa.RecordBatch.from_arrays([pa.array([*named, *buckets.tolist()], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each bucket of a partition that is sorted by bucket, and its blobs; those with negative numbers one by one."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (bucket != now or bucket < 0) and held:
                yield now, held
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield now, held


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, anchor) of the anchors that documents of different doc_ids have."""
    for bucket, blobs in by_key(batches):
        h = np.concatenate([_from_planes(memoryview(b), len(b) // 14, 6, "<u8") for b in blobs])
        ids = np.concatenate([_from_planes(memoryview(b)[len(b) // 14 * 6 :], len(b) // 14, 8, "<i8") for b in blobs])
        if bucket >= 0:
            order = np.argsort(h, kind="stable")
            h, ids = h[order], ids[order]
            first, known = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1]), np.minimum(ids, NULLS)
            several = np.minimum.reduceat(known, first) != np.maximum.reduceat(known, first)
            keep = np.repeat(several, np.diff(np.append(first, len(h))))
            h, ids = h[keep], ids[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h.astype(np.int64))], ["id", "anchor"])


def windows(ids: np.ndarray, strings: list[str], wanted: list[np.ndarray], least: int, bits: int) -> pa.RecordBatch:
    """A row for each bucket: the runs whose anchor the document shares, as RUN records and their strings. A run whose whole string a
    smaller id of the block has goes as it is; its mark is in a row with a negative number, and the bucket does not get it."""
    data, bounds = joined(strings)
    first, count, h = runs(data, bounds, least)
    doc = np.searchsorted(bounds, first, side="right") - 1
    salt = np.arange(len(strings), dtype=np.uint64) * _ODD
    low = np.uint64((1 << 48) - 1)
    have = np.concatenate([(w.astype(np.uint64) ^ s) * _MIX for w, s in zip(wanted, salt, strict=True)])
    keep = np.isin(((h & low) ^ salt[doc]) * _MIX, have)
    first, count, h, doc = first[keep], count[keep], h[keep], doc[keep]
    order, buckets, cuts = _by_bucket(h, bits)
    first, count, h, doc = first[order], count[order], h[order], doc[order]
    rows = np.zeros(len(first), RUN)
    rows["doc_id"], rows["start"], rows["length"] = ids[doc], first - bounds[doc], count + least - 1
    rows["check"] = np.array([check_of(data[a:b].data) for a, b in zip(bounds, bounds[1:], strict=False)], np.int64)[doc]
    rows["anchor"] = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    at, size = first, rows["length"].astype(np.int64)
    blobs, named = [], []
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= again[1:]
    again = np.flatnonzero(again)
    if len(again):
        text, _ = _cut(data, at[again], size[again])
        group, lead = _equal(_matrix(text, size[again], -(-int(size[again].max()) // 8) * 8), size[again])
        known = np.minimum(rows["doc_id"][again], NULLS)
        gone = again[known > np.minimum.reduceat(known[group], lead)[_numbers(group, lead)]]
        if len(gone):
            marks = np.zeros(len(gone), MARK)
            marks["id"], marks["check"], marks["span"] = rows["doc_id"][gone], rows["check"][gone], rows["start"][gone].astype(np.int64) << 16 | size[gone]
            named.append(-1 - int(ids[0]) % 997)
            blobs.append(marks.tobytes())
            stay = np.ones(len(rows), bool)
            stay[gone] = False
            rows, at, size, h = rows[stay], at[stay], size[stay], h[stay]
            _, buckets, cuts = _by_bucket(h, bits)
    text, ends = _cut(data, at, size)
    blobs += [len(rows[a:b]).to_bytes(4, "little") + rows[a:b].tobytes() + text[ends[a] : ends[b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([*named, *buckets.tolist()], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def check_of(text: bytes) -> int:
    """What tells the texts of one doc_id apart: 64 bits of their SHA-256."""
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)


def _cut(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of data, one after another, and where each begins (then the end)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])], ends


def _matrix(text: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Strings that lie one after another as rows, with zeros behind."""
    out = np.zeros((len(size), width), np.uint8)
    out[np.arange(width)[None, :] < size[:, None]] = text
    return out


def _equal(matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of strings in which equal ones are neighbours, and where each group of equal ones begins in it."""
    mixed = length.astype(np.uint64)
    for word in matrix.view("<u8").reshape(len(matrix), -1).T:
        mixed = (mixed ^ word) * _MIX
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = (mixed[order][1:] == mixed[order][:-1]) & (matrix[order[1:]] == matrix[order[:-1]]).all(axis=1) & (length[order][1:] == length[order][:-1])
    return order, np.concatenate([[0], np.flatnonzero(~same) + 1])


def _numbers(order: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The number of each string's group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    return out


def _words(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-th 8 bytes from each position, as numbers that sort as they do. text has 64 bytes to spare."""
    view = np.lib.stride_tricks.as_strided(text[8 * k :].view(), shape=(len(text) - 8 * k - 7, 8), strides=(1, 1))
    return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(np.uint64)


def directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the text from there, to `depth` bytes at least."""
    at = at[np.argsort(_words(text, at, 0), kind="stable")]
    key = _words(text, at, 0)
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else at
    for k in range(1, -(-depth // 8)):
        alone = np.ones(len(at) + 1, bool)
        alone[1:-1] = group[1:] != group[:-1]
        tied = np.flatnonzero(~(alone[:-1] & alone[1:]))
        if not len(tied):
            break
        key = _words(text, at[tied], k)
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied][order]
        key, own = key[order], group[tied]
        more = np.zeros(len(at), np.int64)
        more[tied[1:]] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        changed = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(np.maximum(changed, more))
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions of text in the order of what begins there, to `depth` bytes at least, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly. Bucket by bucket of the first byte, the suffixes larger
    than their successors are then induced: the scan of a bucket puts each predecessor with a larger first byte at the end of
    what its own bucket has; one with an equal first byte, in the same bucket, follows at once."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    run_end = np.flatnonzero(differs)
    up = np.append(text[:-1] < text[1:], True)
    smaller = np.repeat(up[run_end], np.diff(np.concatenate([[-1], run_end])))
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    direct = directly(padded, np.flatnonzero(smaller), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        larger, last = list(induced[c]), np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(last):
            last = last[last > 0] - 1
            last = last[text[last] == c]
            larger.append(last)
        bucket = np.concatenate([*larger, direct[edges[c] : edges[c + 1]]])
        if len(bucket):
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[text[before] > c]
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=256))])
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                induced[d].append(before[cuts[d] : cuts[d + 1]])
    return np.concatenate(out) if n else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """The common prefix, to `most`, of each position of array and the one before; 0 for the first."""
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    out = np.zeros(len(array), np.int64)
    open_ = np.arange(1, len(array))
    for k in range(-(-most // 8)):
        x = _words(padded, array[open_ - 1], k) ^ _words(padded, array[open_], k)
        equal = x == 0
        lead = np.zeros(len(x), np.int64)
        for b in range(1, 8):
            lead += x < np.uint64(1 << (64 - 8 * b))
        out[open_] += np.where(equal, 8, lead)
        open_ = open_[equal]
    return np.minimum(out, most)


def _least_ids(strings: np.ndarray, lengths: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of different strings (rows of a zero-padded matrix), string by string: the smallest id of a string that has
    the window. And where each string's windows begin."""
    used = np.arange(strings.shape[1])[None, :] < lengths[:, None]
    framed = np.zeros((len(strings), strings.shape[1] + 1), np.uint8)
    framed[:, :-1] = np.where(used, strings + np.uint8(1), 0)  # UTF-8 has no byte 255
    keep = np.concatenate([used, np.zeros((len(strings), 1), bool)], axis=1)
    keep[np.arange(len(strings)), lengths] = True  # the end mark
    text = framed[keep]
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    count = lengths - least + 1
    first = np.concatenate([[0], np.cumsum(count)])
    is_window = np.zeros(len(text), bool)
    is_window[np.repeat(begin[:-1] - first[:-1], count) + np.arange(first[-1])] = True
    array = suffix_array(text, least)
    array = array[is_window[array]]
    owner = np.searchsorted(begin, array, side="right") - 1
    equal = np.flatnonzero(common_prefixes(text, array, least) < least)
    lowest = np.minimum.reduceat(ids[owner], equal)
    out = np.empty(len(array), np.int64)
    out[first[owner] + array - begin[owner]] = np.repeat(lowest, np.diff(np.append(equal, len(array))))
    return out, first


def _spans(rows: np.ndarray, matrix: np.ndarray, least: int) -> pa.RecordBatch:
    """Spans to remove of runs that hold all runs of their anchors."""
    length = rows["length"].astype(np.int64)
    order, lead = _equal(matrix, length)
    string = _numbers(order, lead)
    chosen = order[lead]
    ids = np.minimum(rows["doc_id"], NULLS)
    smallest = np.minimum.reduceat(ids[order], lead)
    lowest, first = _least_ids(matrix[chosen], length[chosen], smallest, least)
    count = length - least + 1
    base = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(base[-1]) - np.repeat(base[:-1], count)
    gone = lowest[np.repeat(first[string], count) + within] < np.repeat(ids, count)
    far = np.int64(1 << 40)
    low = np.minimum.reduceat(np.where(gone, within, far), base[:-1])
    high = np.maximum.reduceat(np.where(gone, within, -1), base[:-1])
    hit = high >= 0  # a run has fewer windows than a window has bytes, so its removed windows are one span
    start = rows["start"][hit].astype(np.int64) + low[hit]
    span = start << 16 | (high[hit] - low[hit] + least)
    return pa.RecordBatch.from_arrays([pa.array(rows["doc_id"][hit]), pa.array(rows["check"][hit].astype(np.int64)), pa.array(span)], ["id", "check", "span"])


def equal_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, checksum of the text, start << 16 | length) of spans that a document with a smaller id has as well."""
    width = -(-(2 * least - K) // 8) * 8
    for bucket, blobs in by_key(batches):
        if bucket < 0:
            marks = np.frombuffer(blobs[0], MARK)
            yield pa.RecordBatch.from_arrays([pa.array(marks[c].copy()) for c in MARK.names], [*MARK.names])
            continue
        sizes = [int.from_bytes(b[:4], "little") for b in blobs]
        rows = np.concatenate([np.frombuffer(b, RUN, n, 4) for b, n in zip(blobs, sizes, strict=True)])
        text = np.frombuffer(b"".join(b[4 + n * RUN.itemsize :] for b, n in zip(blobs, sizes, strict=True)), np.uint8)
        begin = np.concatenate([[0], np.cumsum(rows["length"], dtype=np.int64)])
        order = np.argsort(rows["anchor"], kind="stable")
        new = np.concatenate([[True], np.diff(rows["anchor"][order]) != 0])
        load = np.cumsum(rows["length"][order].astype(np.int64))
        part = np.maximum.accumulate(np.where(new, load // ARRAY_BYTES, 0))  # cut between anchors only
        for chosen in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            size = rows["length"][chosen].astype(np.int64)
            matrix = _matrix(_cut(text, begin[chosen], size)[0], size, width)
            yield _spans(rows[chosen], matrix, least)


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of spans coded start << 16 | length."""
    out: list[tuple[int, int]] = []
    for span in sorted(spans):
        start, end = span >> 16, (span >> 16) + (span & 0xFFFF)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _marked(docs: DataFrame, least: int) -> DataFrame:
    """id, text, more (the other columns), digests (of the texts that a smaller id has as well) and marks (spans with the checksum of their text)."""
    if not K < least <= 2 * K + 6:
        raise ValueError(f"least must be from {K + 1} to {2 * K + 6}")
    others, text = [docs[quoted(c)] for c in docs.columns if c != "text"], F.coalesce(docs["text"].cast("string"), F.lit(""))
    # all branches below read these three columns, so that Spark shuffles the texts once and reuses the exchange
    base = docs.select(F.coalesce(F.least(docs["doc_id"].cast("long"), F.lit(NULLS)), F.lit(NULLS) + F.pmod(F.xxhash64(text), F.lit(1 << 40))).alias("id"), text.alias("text"), F.struct(*others).alias("more"))
    digests = base.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("n"))
    total = digests.agg(F.sum("n")).first()[0] or 0
    bits = int(min(BITS[1], max(BITS[0], math.ceil(math.log2(max(1, total / BUCKET_BYTES))))))
    n = partitions(docs)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, strings in blocks(batch, 1, BLOCK):
                yield anchors(block, strings, least, bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, strings in blocks(batch, 1, BLOCK):
                wanted = [w.values.to_numpy(zero_copy_only=False) for w in block.column(block.schema.get_field_index("anchors"))]
                yield windows(block.column(0).to_numpy(zero_copy_only=False), strings, wanted, least, bits)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "bucket").sortWithinPartitions("bucket")

    order = F.least(F.col("id"), F.lit(NULLS))
    first = digests.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last")
    salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a text may have a third of all rows
    of_copies = digests.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["digest", "salt"])
    copies = of_copies.where(order > F.col("first")).groupBy("id").agg(F.collect_set("digest").alias("digests"))
    copied = F.when(F.col("digests").isNull(), False).otherwise(F.array_contains("digests", F.sha2(F.col("text").cast("binary"), 256)))
    unique = base.join(copies, "id", "left").where(~copied)  # the other texts of a copy's id stay
    found = dealt(unique.mapInArrow(seek, "bucket int, blob binary")).mapInArrow(shared_anchors, "id long, anchor long")
    shared = base.join(found.groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "id")
    spans = dealt(shared.mapInArrow(cut, "bucket int, blob binary")).mapInArrow(lambda batches: equal_windows(batches, least), "id long, check long, span long")
    marks = spans.groupBy("id").agg(F.collect_list(F.struct("check", "span")).alias("marks"))
    return base.join(copies, "id", "left").join(marks, "id", "left")


def removed_spans(text: bytes, digests: list[str] | None, marks: list[dict] | None, least: int) -> list[tuple[int, int]]:
    """What goes from one text."""
    if digests and len(text) >= least and hashlib.sha256(text).hexdigest() in digests:
        return [(0, len(text))]
    if not marks:
        return []
    check = check_of(text)
    return merged([m["span"] for m in marks if m["check"] == check])


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def _rows(batch: pa.RecordBatch, least: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    for text, digests, marks in zip(batch.column("text"), batch.column("digests"), batch.column("marks"), strict=True):
        raw = text.as_py().encode("utf-8", "surrogatepass")
        yield raw, removed_spans(raw, digests.as_py(), marks.as_py(), least)


def repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of what is left) for each row of docs(doc_id, text, ...)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest()) for raw, spans in _rows(batch, least)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("more").field("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), least).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs without the removed bytes (a character that loses a byte goes whole), and n_chars, if there, recounted. Rows stay, even if empty; a null text becomes empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [without(raw, spans).decode("utf-8", "ignore") if spans else raw.decode("utf-8", "surrogatepass") for raw, spans in _rows(batch, least)]
            yield pa.RecordBatch.from_arrays([batch.column("more"), pa.array(kept, pa.string())], ["more", "text"])

    marked = _marked(docs, least)
    left = marked.mapInArrow(work, T.StructType([marked.schema["more"], T.StructField("text", T.StringType())]))
    recounted = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return left.select(*(F.col("text") if c == "text" else recounted.alias(c) if c == "n_chars" else F.col("more")[c].alias(c) for c in docs.columns))
