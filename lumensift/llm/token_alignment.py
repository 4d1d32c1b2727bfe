"""Alignment of the tokens of two tokenizers, by segment deduplication.

A byte-level BPE (A) reads a space and the text; a SentencePiece BPE (B) reads the text and puts the space before it itself. The text is
cut before runs of white space, at those characters alone where neither vocabulary can join across the cut (see cut_marks()), so that the tokens and groups of a
text are those of its segments, one after another.

1. Texts are read in blocks of about BLOCK bytes. A block becomes a dictionary of its different segments, and documents as numbers in it.
2. The dictionaries' rows are shuffled by segment and sorted, so equal segments meet; each is tokenised and aligned once. A frequent segment has one row a block, not one an occurrence.
3. Alignments join the blocks that asked for them, and the block's documents are composed. A block counts in how many of its documents it has
   each linked pair of ids; Spark adds these up over all blocks.
4. Totals go back to the blocks with that pair, and are summed over the documents' links.

Null, empty: no tokens. A text whose tokens do not give back its bytes (one with U+2581, which B reads as a space): no tokens either, and its pairs count nowhere.
Null doc_id, repeated rows: each row is a document. Very long texts: a block of their own; a text without white space is one segment. Empty table: no rows.
Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumensift.llm.common import new_path, removed, slices, texts, written
from lumensift.llm.merging import merged
from lumensift.llm.numbered import Numbered, Ragged, within
from lumensift.llm.piece_dropout import SPACE, PieceModel, default_model
from lumensift.llm.token_counts import PieceCounter, default_tokenizer

#: Bytes of text of a block, and of those split together; segments aligned together; segments composed together; links of a group that are written out one by one.
BLOCK, SPLIT, TOGETHER, COMPOSED, GROUP_LINKS = 32_000_000, 4_000_000, 40_000, 100_000, 1 << 16
#: White space before which a text may be cut, if the vocabularies allow it.
CANDIDATES = " \n\t\v\f\r\x85\xa0\u2003\u3000"
#: A space that does not begin a segment, as RE2 reads it: the first one, which the added space precedes, or one after other white space.
BEFORE_SPACE = r"^ |[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_LINES, _GROUPS, _SIDES = ord("\n"), ord(";"), ord("|")


class Aligner:
    """Both tokenizers, as tables."""

    def __init__(self, tokenizer: str, model: str):
        self.a, self.b = PieceCounter(tokenizer), PieceModel(model)
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.a_size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a letter of the vocabulary is a byte
        for piece, i in vocabulary.items():
            self.a_size[i] = len(piece)
        self.b_size = self.b.raw.size[: self.b.raw.rows].astype(np.int64)
        most = max(len(self.a_size), len(self.b_size))
        self.written = {sep: np.array([f"{i}{sep}" for i in range(most)], object) for sep in ",|;\n"}
        marks = re.escape(self.cut_marks())
        #: A segment: white space, then all up to the next white space that begins with a mark.
        self.split = re.compile(rf"\s*\S+(?:(?![{marks}])\s+\S*)*|\s+").findall

    def cut_marks(self) -> str:
        """White space before which neither tokenizer joins: the first always begins a pre-token there, whatever comes before, and
        no piece of the second has it after something else than white space (a merge across the cut would make such a piece)."""
        before = re.compile(rf"[^\s{SPACE}]([\s{SPACE}])")
        crossed = {m.replace(SPACE, " ") for piece in self.b.ids for m in before.findall(piece)}

        def begins(mark: str) -> bool:
            tries = [x + mark + y for x in ("a", "7", "!", "é", "\x00", "'s") for y in ("a", "7", "!", mark + "a", "")]
            return all(any(start == len(t.split(mark)[0]) for _, (start, _) in self.a.tokenizer.pre_tokenizer.pre_tokenize_str(t)) for t in tries)

        return "".join(c for c in CANDIDATES if c not in crossed and begins(c))

    def aligned(self, segments: list[str]) -> list[str]:
        """Of each segment its groups as text (`a1,a2|b1;a3|b2,b3`), or an empty text if its tokens do not give back its bytes."""
        good = [s for s in segments if SPACE not in s]
        if len(good) < len(segments):
            found = iter(self.aligned(good) if good else [])
            return ["" if SPACE in s else next(found) for s in segments]
        pretokens = [self.a.pretokens(s) for s in segments]
        raw = [w.encode("utf-8", "surrogatepass") for w in chain.from_iterable(pretokens)]
        a, counts, _ = merged(self.a.letters[np.frombuffer(b"".join(raw), np.uint8)], np.fromiter(map(len, raw), np.int64, len(raw)), self.a.table)
        flat, sizes = self.b._first_symbols(segments)
        b, b_counts, _ = merged(flat, sizes, self.b.pairs)
        a, b = a.astype(np.int64), b.astype(np.int64)
        if self.b.raw.take(b)[0].tobytes() != b"".join(raw):
            return [""] if len(segments) == 1 else self.aligned(segments[: len(segments) // 2]) + self.aligned(segments[len(segments) // 2 :])
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        last = np.zeros(len(common), bool)  # groups that end a segment
        last[b_group[np.cumsum(b_counts) - 1]] = True
        a_of, b_of = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
        ends_a, ends_b = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        out = np.empty(len(a) + len(b), object)
        place = np.arange(len(a)) + (np.cumsum(b_of) - b_of)[a_group]
        out[place] = np.where(ends_a, self.written["|"][a], self.written[","][a])
        place = np.arange(len(b)) + np.cumsum(a_of)[b_group]
        out[place] = np.where(ends_b, np.where(last[b_group], self.written["\n"][b], self.written[";"][b]), self.written[","][b])
        return "".join(out.tolist()).split("\n")[:-1]


@cache
def aligner(tokenizer: str, model: str) -> Aligner:
    return Aligner(tokenizer, model)


# --- 1: blocks


class _Block:
    """The different segments of some documents, and the documents as numbers of these."""

    def __init__(self, split):
        self.split, self.size = split, 0
        self.segments, self.words, self.segments_of = Numbered(), Numbered(), Ragged("<u4")
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []

    def add(self, batch: pa.RecordBatch) -> None:
        """Texts with single spaces alone are split at these by Arrow, and each different word between them once more by split()."""
        column = batch.column(1)
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        apart = pc.match_substring_regex(column, BEFORE_SPACE)  # where more white space stands before a space than that space
        apart = apart.to_numpy(zero_copy_only=False).astype(bool) & (sizes > 0)
        plain = ~apart & (sizes > 0)
        counts = np.zeros(len(column), np.int64)
        found = pc.split_pattern(column.filter(pa.array(plain)), " ")
        words = found.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.words.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        if new := self.words.new:
            segments = [self.split(" " + w) for w in new]
            self.segments_of.append(np.fromiter(map(self.segments.__getitem__, chain.from_iterable(segments)), np.uint32), np.fromiter(map(len, segments), np.int64, len(segments)))
            new.clear()
        flat, many = self.segments_of.take(numbers[words.indices.to_numpy()])
        offsets = found.offsets.to_numpy()
        counts[plain] = np.diff(np.concatenate([[0], np.cumsum(many)])[offsets - offsets[0]])
        if apart.any():
            others = [self.split(" " + text) for text in column.filter(pa.array(apart)).to_pylist()]
            counts[apart] = [len(s) for s in others]
            out, is_plain = np.empty(int(counts.sum()), np.uint32), np.repeat(plain, counts)
            out[is_plain], out[~is_plain] = flat, np.fromiter(map(self.segments.__getitem__, chain.from_iterable(others)), np.uint32)
            flat = out
        self.doc_ids.append(batch.column(0))
        self.counts.append(counts)
        self.numbers.append(flat)
        self.size += int(sizes.sum())

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """One row with the documents, and one for each segment."""
        ids, counts = pa.concat_arrays(self.doc_ids), np.concatenate(self.counts)
        packed = _packed(pa.table({"doc_id": ids, "n": counts}), np.concatenate(self.numbers))
        yield _batch([block], [None], [None], [packed])
        segments = list(self.segments)
        for i in range(0, len(segments), TOGETHER):
            part = segments[i : i + TOGETHER]
            yield _batch([block] * len(part), range(i, i + len(part)), part, [None] * len(part))


def _batch(block, place, segment, packed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(place, pa.int32()), pa.array(segment, pa.string()), pa.array(packed, pa.binary())], ["block", "place", "segment", "packed"])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their first bytes together, then their second ones, and so on."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _packed(rows: pa.Table, *numbers: np.ndarray) -> bytes:
    """Rows, and arrays of 32-bit numbers, compressed."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(rows)
    parts = [out.getvalue(), *(pa.compress(_planes(n), "zstd", asbytes=True) for n in numbers)]
    sizes = np.array([len(parts), *map(len, parts), *map(len, numbers)], "<i8")
    return b"".join([sizes.tobytes(), *parts])


def _unpacked(raw: bytes) -> tuple[pa.Table, ...]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8).tolist()
    parts, at = [], 16 * n
    for size in sizes[:n]:
        parts.append(raw[at : at + size])
        at += size
    numbers = [_numbers(pa.decompress(p, 4 * many, "zstd", asbytes=True)) for p, many in zip(parts[1:], sizes[n:], strict=False)]
    return pa.ipc.open_stream(parts[0]).read_all(), *numbers


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer: str, model: str) -> Iterator[pa.RecordBatch]:
    split = aligner(tokenizer, model).split
    number = TaskContext.get().partitionId() << 32
    block = None
    for batch in batches:
        for part in slices(batch, limit=SPLIT):
            if block and block.size + pc.sum(pc.binary_length(part.column(1))).as_py() > BLOCK:
                yield from block.rows(number)
                block, number = None, number + 1
            block = block or _Block(split)
            block.add(part)
    if block:
        yield from block.rows(number)


# --- 2: segments


_GROUPS_OF = "block long, n int, size int, packed binary"


def _align(batches: Iterator[pa.RecordBatch], tokenizer: str, model: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment, some at a time: for each block that asked for some of them a row with their places and groups, compressed. What the last segment had is kept for the next rows."""
    known, held, n = ("", ""), [], 0

    def done() -> pa.RecordBatch:
        nonlocal known
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        encoded = rows.column(2).dictionary_encode()
        different = encoded.dictionary.to_pylist()
        again = different[0] == known[0]
        groups = [known[1]] * again + (aligner(tokenizer, model).aligned(different[again:]) if len(different) > again else [])
        known = (different[-1], groups[-1])
        block, place, number = (x.to_numpy() for x in (rows.column(0), rows.column(1), encoded.indices))
        order = np.lexsort((place, block))
        block, place, number = block[order], place[order], number[order].tolist()
        first = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        ends = [*first[1:].tolist(), len(block)]
        raw = [_planes(np.diff(place[a:b], prepend=0)) + "\n".join([groups[i] for i in number[a:b]]).encode() for a, b in zip(first.tolist(), ends, strict=True)]
        columns = [pa.array(block[first], pa.int64()), pa.array(np.diff([*first, len(block)]), pa.int32()), pa.array(map(len, raw), pa.int32()), pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "n", "size", "packed"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= TOGETHER:
            yield done()
            held, n = [], 0
    if held:
        yield done()


def _asked(rows: pa.Table) -> list[str]:
    """The groups of a block's segments, by place, from what _align() made."""
    groups = [""] * sum(rows["n"].to_pylist())
    for n, size, packed in zip(*(rows[c].to_pylist() for c in ("n", "size", "packed")), strict=True):
        raw = pa.decompress(packed, size, "zstd", asbytes=True)
        for place, text in zip(np.cumsum(_numbers(raw[: 4 * n])).tolist(), raw[4 * n :].decode().split("\n"), strict=True):
            groups[place] = text
    return groups


# --- 3: documents


class _Groups:
    """What the groups of a block's segments say: counts for each segment, and its links as numbers of different pairs of ids."""

    def __init__(self, groups: list[str]):
        parts = [_parsed(groups[i : i + TOGETHER]) for i in range(0, max(1, len(groups)), TOGETHER)]
        self.bad, self.n_a, self.n_b, self.n_groups, self.n_links, sizes, pair, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        self.pairs = np.unique(pair)
        self.links, self.times = Ragged("<i4"), Ragged(times.dtype)
        self.links.append(np.searchsorted(self.pairs, pair).astype(np.int32), sizes)
        self.times.append(times, sizes)
        self.once = bool((times == 1).all())


def _parsed(groups: list[str]) -> tuple[np.ndarray, ...]:
    """Of some segments: which have no tokens, counts of ids, groups and links, and how many pairs each has; of each pair its ids and how often it is linked."""
    raw = np.frombuffer(("\n".join(groups) + "\n" if groups else "").encode(), np.uint8)
    end = np.flatnonzero((raw < 48) | (raw > 57))
    sep, digits = raw[end], np.diff(end, prepend=-1).astype(np.int32) - 1
    value = np.zeros(len(end), np.int32)
    for i in range(int(digits.max()) if len(digits) else 0):
        has = np.flatnonzero(digits > i)
        value[has] += (raw[end[has] - 1 - i].astype(np.int32) - 48) * 10**i
    line = sep == _LINES
    segment = _number(line)
    bad = np.zeros(len(groups), bool)
    bad[segment[digits == 0]] = True
    good = digits > 0
    value, sep, segment, line = value[good], sep[good], segment[good], line[good]
    closes = line | (sep == _GROUPS)
    group = _number(closes)
    of_group = segment[closes]
    n = len(of_group)
    bar = np.flatnonzero(sep == _SIDES).astype(np.int32)  # the last token of the first tokenizer, in each group
    is_a = np.arange(len(value), dtype=np.int32) <= bar[group] if n else np.zeros(0, bool)
    n_a, n_b = np.bincount(group[is_a], minlength=n), np.bincount(group[~is_a], minlength=n)
    links = n_a * n_b
    sums = [np.bincount(of_group, weights=w, minlength=len(groups)).astype(np.int64) for w in (n_a, n_b, np.ones(n), links)]
    small = links <= GROUP_LINKS
    a_at = np.flatnonzero(is_a & small[group]) if n else np.zeros(0, np.int64)
    many = n_b[group[a_at]]
    other = np.repeat(bar[group[a_at]] + 1, many) + within(many).astype(np.int32)
    pair, of_segment, times = [np.repeat(value[a_at].astype(np.int64) << 32, many) | value[other]], [np.repeat(segment[a_at], many)], [np.ones(len(other), np.int32)]
    for g in np.flatnonzero(~small).tolist():  # each different pair once, with how often it comes
        (a, a_times), (b, b_times) = (np.unique(value[(group == g) & side].astype(np.int64), return_counts=True) for side in (is_a, ~is_a))
        pair.append((a[:, None] << 32 | b[None, :]).ravel())
        times.append((a_times[:, None] * b_times[None, :]).ravel())
        of_segment.append(np.full(len(a) * len(b), of_group[g], np.int32))
    pair, of_segment, times = (x[0] if len(x) == 1 else np.concatenate(x) for x in (pair, of_segment, times))
    if len(of_segment) and (np.diff(of_segment) < 0).any():
        order = np.argsort(of_segment, kind="stable")
        pair, times = pair[order], times[order]
    return bad, *sums, np.bincount(of_segment, minlength=len(groups)), pair, times


def _number(ends: np.ndarray) -> np.ndarray:
    """The number of the run that each place is in, where runs end."""
    return np.cumsum(ends, dtype=np.int32) - ends


_COMPOSED = "block long, pair long, number int, n long, packed binary"


def _compose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one block: a row with its documents, and a row for each pair that is linked in them with the number of documents."""
    block = key[0].as_py()
    groups = _asked(right)
    found = _Groups(groups)
    out, documents = [], np.zeros(len(found.pairs), np.int64)
    for packed in left["packed"]:  # one, as a block is written by one task
        rows, numbers = _unpacked(packed.as_py())
        counts = rows["n"].to_numpy()
        begin = np.cumsum(counts) - counts
        parts = [_run(found, groups, numbers[begin[a] : begin[a] + counts[a:b].sum()], counts[a:b], documents) for a, b in _runs(counts, COMPOSED)]
        tables, steps, times = zip(*parts, strict=True) if parts else ((), (), ())
        table = pa.concat_tables(tables) if tables else pa.table({c: pa.array([], k) for c, k in (("n_a", pa.int64()), ("n", pa.int64()))})
        out.append(_packed(table.append_column("doc_id", rows["doc_id"]), *(np.concatenate([*x, np.zeros(0, np.uint32)]) for x in (steps, times))))
    linked = np.flatnonzero(documents)
    n = len(out)
    return pa.table(
        {
            "block": pa.array(np.full(n + len(linked), block), pa.int64()),
            "pair": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(found.pairs[linked], pa.int64())]),
            "number": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(linked.astype(np.int32))]),
            "n": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(documents[linked], pa.int64())]),
            "packed": pa.concat_arrays([pa.array(out, pa.binary()), pa.nulls(len(linked), pa.binary())]),
        }
    )


def _runs(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows with about `limit` in total, from and up to; a larger one alone."""
    ends, start = np.cumsum(counts), 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield start, end
        start = end


def _run(found: _Groups, groups: list[str], numbers: np.ndarray, counts: np.ndarray, documents: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Some documents: their own columns, and their different pairs in order (as steps) with how often each comes. Adds to `documents` of each pair."""
    of = np.repeat(np.arange(len(counts)), counts)
    bad = np.bincount(of, weights=found.bad[numbers], minlength=len(counts)) > 0
    if bad.any():
        numbers, of = numbers[~bad[of]], of[~bad[of]]
        counts = np.where(bad, 0, counts)
    sums = {name: np.bincount(of, weights=getattr(found, name)[numbers], minlength=len(counts)).astype(np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    texts, digests, at = list(map(groups.__getitem__, numbers.tolist())), [], 0
    for n in counts.tolist():
        digests.append(hashlib.sha256(";".join(texts[at : at + n]).encode()).hexdigest() if n else "")
        at += n
    flat, sizes = found.links.take(numbers)
    key = np.repeat(of << 32, sizes) | flat
    if found.once:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, each = key[order], found.times.take(numbers)[0][order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    many = np.diff(first, append=len(key)) if found.once else np.add.reduceat(each, first) if len(first) else each
    key = key[first]
    pairs, sizes = key & 0xFFFFFFFF, np.bincount(key >> 32, minlength=len(counts))
    documents += np.bincount(pairs, minlength=len(documents))
    return pa.table({**sums, "groups_sha256": digests, "n": sizes}), _steps(pairs, sizes).astype(np.uint32), many.astype(np.uint32)


def _steps(sorted_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences within each of some ordered arrays, which take fewer bytes than their numbers."""
    out = np.diff(sorted_, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = sorted_[first]
    return out


# --- 4: totals

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _total(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of the totals over the links of a block's documents."""
    number = right["number"].to_numpy()
    total, best = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64), np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    total[number], best[number] = right["total"].to_numpy(), right["best"].to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for packed in left["packed"]:
        rows, pair, times = _unpacked(packed.as_py())
        n = rows["n"].to_numpy()
        ends = np.concatenate([[0], np.cumsum(n)])
        run = np.concatenate([[0], np.cumsum(pair.astype(np.int64))])
        at = run[1:] - np.repeat(run[ends[:-1]], n)
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[at] * times)])[ends]) for x in (best, total)]
        out.append(rows.drop_columns(["n"]).append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64())))
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return pa.concat_tables([t.select(names) for t in out])


def alignments(docs: DataFrame, tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """RESULT for each row of docs(doc_id, text, ...)."""
    a, b = tokenizer or default_tokenizer(), model or default_model()
    spark, paths = docs.sparkSession, [new_path(docs.sparkSession) for _ in range(2)]
    blocks = written(texts(docs).mapInArrow(lambda batches: _blocks(batches, a, b), "block long, place int, segment string, packed binary"), paths[0])
    segments = blocks.where("packed is null").select("block", "place", "segment").repartition("segment").sortWithinPartitions("segment")
    groups = segments.mapInArrow(lambda batches: _align(batches, a, b), _GROUPS_OF)
    composed = blocks.where("packed is not null").select(F.col("block").alias("of"), "packed").groupBy("of").cogroup(groups.groupBy("block")).applyInArrow(_compose, _COMPOSED)
    composed = written(composed, paths[1])
    removed(spark, paths[0])
    linked = composed.where("packed is null").select("block", "pair", "number", "n")
    totals = linked.groupBy("pair").agg(F.sum("n").alias("total"))
    best = F.col("total") == F.max("total").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most as many rows a window as the second vocabulary has ids
    known = linked.select("block", "pair", "number").join(totals.select("pair", "total", best.alias("best")), "pair").select("block", "number", "total", "best")
    documents = composed.where("packed is not null").select(F.col("block").alias("of"), "packed")
    return documents.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(_total, RESULT)
