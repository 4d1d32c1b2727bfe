"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges of a BPE model are taken from an agenda by score, then position. Each merge that comes up is skipped if a keyed hash is below
`dropout`; the key is (seed, doc_id, place of the unit in the text, how many merges came up in it before). So every occurrence
is segmented by draws of its own, and every run, on any partitioning, gives the same ids. With dropout 0 they are those of the sentencepiece library.

A text is cut into units (a word or a run of other characters, with the white space before it) that no piece of the
vocabulary crosses. A unit's segmentation follows from which of its merges are skipped, so a worker keeps, for each set of skipped merges that
it has met, the ids and where further skips lead to; occurrences walk through these nodes together. Units too long for that are merged one by one.

Characters without a piece become byte pieces; so does U+2581, which the model uses for spaces, so decoding gives the text back
whatever it holds.

Null text: empty, no ids. Null doc_id: as 0. Repeated rows have equal ids. Empty table: no rows. Long units (a text without
spaces) go over the same agenda, in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumensift.llm.common import slices, texts
from lumensift.llm.merging import PairTable, merged
from lumensift.llm.numbered import Numbered, Ragged, within

SPACE = "▁"
#: Symbols of a unit that is kept, at most; segmentations, different words and their characters that a worker keeps; bytes of text together.
LONGEST, KEPT, WORDS, CHARS, BLOCK = 20, 1_600_000, 800_000, 16_000_000, 3_000_000
UNIT = re.compile(r" *[^\x00-\x40\x5b-\x60\x7b-\xbf -⁯]+| *[\x00-\x1f\x21-\x40\x5b-\x60\x7b-\xbf -⁯]+| +").findall
COARSE = re.compile(r" *[^ ]+| +").findall
_MASK = (1 << 64) - 1
_ODD, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mixed(x):
    """Mixes the bits of an integer, or of an array of unsigned ones."""
    if isinstance(x, np.ndarray):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def key_of(seed: int, doc_id: int, place: int) -> int:
    """The key of the unit at a place (from 0) of a document."""
    return mixed(mixed((doc_id & _MASK) ^ mixed(seed & _MASK)) + place * _ODD & _MASK)


def skips(key: int, step: int, dropout: float) -> bool:
    """Whether a unit skips the merge that comes up after `step` others. A hash of 64 bits serves two steps."""
    x = (key + step // 2 * _STEP) & _MASK
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _MASK
    x ^= x >> 29
    return (x >> 32 if step % 2 else x & 0xFFFFFFFF) < round(dropout * (1 << 32))


def skipped(keys: np.ndarray, steps: int, dropout: float) -> np.ndarray:
    """skips() of many keys and of the first `steps` (64 at most) steps, as bits."""
    limit, out = np.uint64(round(dropout * (1 << 32))), np.zeros(len(keys), np.uint64)
    for step in range(0, steps, 2):
        x = keys + np.uint64(step // 2 * _STEP & _MASK)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        out |= ((x & np.uint64(0xFFFFFFFF)) < limit).astype(np.uint64) << np.uint64(step)
        out |= ((x >> np.uint64(32)) < limit).astype(np.uint64) << np.uint64(step + 1)
    return out


class PieceModel:
    """A SentencePiece BPE model with byte fallback and identity normalisation, as tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte = [0] * 256
        raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.scores.append(model.get_score(i))
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                self.ids[piece] = i
                raw.append(piece.replace(SPACE, " ").encode())
        self.raw = Ragged("u1")
        self.raw.append(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]))
        self.split = UNIT if all(len(UNIT(p.replace(SPACE, " "))) == 1 for p in self.ids) else COARSE
        rank = np.unique(-np.array(self.scores), return_inverse=True)[1]
        pairs = [(self.ids[a], self.ids[b], i) for piece, i in self.ids.items() for k in range(1, len(piece)) if (a := piece[:k]) in self.ids and (b := piece[k:]) in self.ids]
        left, right, joined = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank[joined], joined)
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.of_char[ord(" ")], self.of_char[ord(SPACE)] = self.of_char[ord(SPACE)], -1
        self.clear()

    def clear(self) -> None:
        self.words, self.units_of = Numbered(), Ragged("<i4")
        self.units, self.symbols, self.chars = Numbered(), Ragged("<i4"), 0
        self.root = Ragged("<i4")  # of each unit its node, or -1 if it is too long
        self.segments = Ragged("<u4")  # of each node its ids
        #: Of each node: unit, merges skipped (bits), place after the last of them, merges that come up if no further one is skipped, and where its row of `next` begins.
        self.node = np.zeros(0, [("unit", "<i4"), ("bits", "<u8"), ("from", "u1"), ("to", "u1"), ("row", "<i8")])
        self.nodes, self.next, self.n_next = 0, np.zeros(1024, np.int32), 0

    def segment(self, unit: str, key: int = 0, dropout: float = 0.0) -> list[int]:
        """Ids of a unit, plainly. A unit's spaces stand for the model's space mark."""
        ids = self.ids
        symbols = [" " if c == SPACE else SPACE if c == " " else c for c in unit]  # the mark itself is no piece, so it goes to bytes
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str, str]] = []

        def propose(left: int, right: int) -> None:
            if (found := ids.get(symbols[left] + symbols[right])) is not None:
                heapq.heappush(agenda, (-self.scores[found], left, right, symbols[left], symbols[right]))

        for i in range(n - 1):
            propose(i, i + 1)
        step = 0
        while agenda:
            _, left, right, first, second = heapq.heappop(agenda)
            if symbols[left] != first or after[left] != right or symbols[right] != second:
                continue
            step += 1
            if dropout and skips(key, step - 1, dropout):
                continue
            symbols[left], symbols[right] = first + second, None
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                propose(left, following)
            if before[left] >= 0:
                propose(before[left], left)
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (found := ids.get(s)) is not None:
                out.append(found)
            else:
                out += (self.byte[b] for b in (SPACE if s == " " else s).encode("utf-8", "surrogatepass"))
        return out

    def _first_symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that merging starts from: a piece for each character, or byte pieces, which no merge joins."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.of_char[chars]
        lost = np.flatnonzero(symbols < 0)
        if not len(lost):
            return symbols, sizes
        raw = [[self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars[lost].tolist()]
        many = np.ones(len(symbols), np.int64)
        many[lost] = [len(r) for r in raw]
        out = np.repeat(symbols, many)
        out[out < 0] = list(chain.from_iterable(raw))
        return out, np.diff(np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(sizes)])])

    def _add_nodes(self, unit: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """New nodes of these units (not too long) with these merges skipped."""
        flat, sizes = self.symbols.take(unit)
        ids, counts, decided = merged(flat, sizes, self.pairs, lambda words, step: (bits[words] >> np.uint64(step) & np.uint64(1)).astype(bool))
        self.segments.append(ids, counts)
        first, n = self.nodes, len(unit)
        if first + n > len(self.node):
            self.node = np.concatenate([self.node, np.zeros(max(n, len(self.node), 1024), self.node.dtype)])
        new = self.node[first : first + n]
        after = np.zeros(n, np.int64)
        some = bits > 0
        after[some] = np.floor(np.log2(bits[some].astype(np.float64))).astype(np.int64) + 1
        room = decided - after
        new["unit"], new["bits"], new["from"], new["to"] = unit, bits, after, decided
        new["row"] = self.n_next + np.cumsum(room) - room - after
        total = self.n_next + int(room.sum())
        if total > len(self.next):
            self.next = np.concatenate([self.next, np.zeros(max(total, 2 * len(self.next)) - len(self.next), np.int32)])
        self.next[self.n_next : total] = -1
        self.nodes, self.n_next = first + n, total
        return np.arange(first, first + n, dtype=np.int32)

    def _learn_units(self) -> None:
        new = self.units.new
        if not new:
            return
        flat, sizes = self._first_symbols(new)
        first = self.symbols.rows
        self.symbols.append(flat, sizes)
        self.chars += sum(map(len, new))
        root = np.full(len(new), -1, np.int32)
        short = np.flatnonzero(sizes <= LONGEST)
        if len(short):
            root[short] = self._add_nodes(first + short, np.zeros(len(short), np.uint64))
        self.root.append(root, np.ones(len(new), np.int64))
        new.clear()

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of a space and of each text, by number, and how many each text has (an empty text: none)."""
        empty = pc.equal(pc.binary_length(column), 0)
        apart = pc.or_(pc.match_substring(column, "  "), pc.starts_with(column, " "))  # else each word has the one space before it
        plain = pc.and_not(pc.invert(apart), empty).to_numpy(zero_copy_only=False).astype(bool)
        apart = apart.to_numpy(zero_copy_only=False).astype(bool)
        found = pc.split_pattern(column.filter(pa.array(plain)), " ")
        words = found.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(words.dictionary))
        if new := self.words.new:
            units = [self.split(" " + w) for w in new]
            sizes = np.fromiter(map(len, units), np.int64, len(units))
            self.units_of.append(np.fromiter(map(self.units.__getitem__, chain.from_iterable(units)), np.int64), sizes)
            new.clear()
        flat, sizes = self.units_of.take(numbers[words.indices.to_numpy()])
        counts = np.zeros(len(column), np.int64)
        counts[plain] = np.diff(np.concatenate([[0], np.cumsum(sizes)])[found.offsets.to_numpy() - found.offsets[0].as_py()])
        if not apart.any():
            return flat, counts
        others = [self.split(" " + text) for text in column.filter(pa.array(apart)).to_pylist()]
        counts[apart] = [len(u) for u in others]
        out, is_plain = np.empty(int(counts.sum()), np.int64), np.repeat(plain, counts)
        out[is_plain], out[~is_plain] = flat, np.fromiter(map(self.units.__getitem__, chain.from_iterable(others)), np.int64)
        return out, counts

    def encode(self, column: pa.Array, doc_ids: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if self.nodes > KEPT or len(self.words) > WORDS or self.chars > CHARS:
            self.clear()
        units, counts = self._units(column)
        self._learn_units()
        with np.errstate(over="ignore"):
            documents = mixed(doc_ids.astype(np.int64).view(np.uint64) ^ np.uint64(mixed(seed & _MASK)))
            keys = mixed(np.repeat(documents, counts) + within(counts).astype(np.uint64) * np.uint64(_ODD))
        node = self.root.values[units]  # one each
        if dropout:
            self._walk(node, keys, dropout)
        long = np.flatnonzero(node < 0)
        flat, sizes = self.segments.take(np.delete(node, long))
        if len(long):
            first, n = self.symbols.take(units[long])
            own, many, _ = merged(first, n, self.pairs, (lambda words, step: self._draw(keys[long[words]], step, dropout)) if dropout else None)
            all_sizes = np.zeros(len(node), np.int64)
            all_sizes[node >= 0], all_sizes[long] = sizes, many
            out, kept = np.empty(len(flat) + len(own), "<u4"), np.repeat(node >= 0, all_sizes)
            out[kept], out[~kept] = flat, own
            flat, sizes = out, all_sizes
        return flat, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])])

    @staticmethod
    def _draw(keys: np.ndarray, step: int, dropout: float) -> np.ndarray:
        """skips() of many keys at one step."""
        bits = skipped(keys + np.uint64(step // 2 * _STEP & _MASK), 2, dropout)
        return (bits >> np.uint64(step % 2) & np.uint64(1)).astype(bool)

    def _walk(self, node: np.ndarray, keys: np.ndarray, dropout: float) -> None:
        """Moves each occurrence from its unit's node (in place) to that of the merges that it skips."""
        one, steps = np.uint64(1), 16
        bits = skipped(keys, steps, dropout)
        wide = np.flatnonzero((node >= 0) & (self.node["to"][node] > steps))
        bits[wide] = skipped(keys[wide], 64, dropout)
        at, here = np.arange(len(node)), self.node[node]
        open_ = node >= 0
        while True:
            ahead = bits >> here["from"].astype(np.uint64) << here["from"].astype(np.uint64)
            lowest = ahead & (~ahead + one)
            open_ &= (ahead > 0) & (lowest >> np.minimum(here["to"], 63).astype(np.uint64) == 0)
            if not open_.any():
                return
            at, bits, lowest, here = at[open_], bits[open_], lowest[open_], here[open_]
            edge = here["row"] + np.bitwise_count(lowest - one)
            missing = np.flatnonzero(self.next[edge] < 0)
            if len(missing):
                new, first = np.unique(edge[missing], return_index=True)
                first = missing[first]
                self.next[new] = self._add_nodes(here["unit"][first].astype(np.int64), here["bits"][first] | lowest[first])
            node[at] = self.next[edge]
            wider = np.flatnonzero(self.node["to"][node[at]] > steps)
            bits[wider] = skipped(keys[at[wider]], 64, dropout)
            here, open_ = self.node[node[at]], np.ones(len(at), bool)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of texts whose ids lie one after another."""
        raw, sizes = self.raw.take(ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        whole = raw.tobytes()
        return [whole[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]  # without the space that encode() put first


@cache
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, seed: int, dropout: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block in slices(batch, limit=BLOCK):
            yield block, *model_of(path).encode(block.column(1), pc.fill_null(block.column(0), 0).to_numpy(), seed, dropout)


def encoded(docs: DataFrame, model: str | None = None, seed: int = 1, dropout: float = 0.1) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs(doc_id, text, ...)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, counts in _encoded(batches, path, seed, dropout):
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of each row of rows(doc_id, ids). Null ids: null text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            raw = model_of(path).decode(batch.column(1).flatten().to_numpy(), counts)
            text = [r.decode("utf-8", "surrogatepass") if known else None for r, known in zip(raw, batch.column(1).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None, seed: int = 1, dropout: float = 0.1) -> DataFrame:
    """Encodes and decodes each row: doc_id, n_bytes, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, lossless."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, counts in _encoded(batches, path, seed, dropout):
            back = model_of(path).decode(ids, counts)
            ends, view = np.concatenate([[0], np.cumsum(counts)]).tolist(), memoryview(ids.tobytes())
            same = [a == b.as_buffer() for a, b in zip(map(pa.py_buffer, back), block.column(1).cast(pa.binary()), strict=True)]
            columns = [
                pc.cast(pc.binary_length(block.column(1)), pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([block.column(0), *columns], ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
