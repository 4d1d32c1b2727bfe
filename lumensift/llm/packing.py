"""Packing into training sequences by estimated attention cost.

Cost-balanced packing: the cost of a piece is estimated as linear * tokens + quadratic * tokens**2 (attention stays
within a document), and pieces, in descending order, each go to the lowest-cost sequence that has room.

1. Each text is tokenized once: its words become numbers of a worker's dictionary, and their ids are gathered from one
   array. A document is cut at multiples of the sequence length; these whole sequences are full. Its rest keeps the running CRC-32 at every GRANULE tokens.
2. Rests are dealt by a hash into groups of about GROUP_ROWS documents, however many documents there are (copies of a row
   are numbered, so that they spread as well), and each group is packed by itself into the least number of sequences that can hold its tokens. A piece that fits nowhere is cut at a
   multiple of GRANULE and fills the emptiest sequence; its rest goes on. So a sequence lacks less than GRANULE tokens,
   but for the last of a group. The CRC-32 of a cut piece follows from the running values, without the ids.

Null text: empty (the end id alone). Null doc_id, repeated rows: each row is packed as a document of its own. Ties go by
doc_id and start. Empty table: no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import slices, texts
from lumensift.llm.merging import byte_letters, merged, table_of
from lumensift.llm.numbered import Numbered, Ragged

#: Documents of a group that is packed together, tokens between possible cuts.
GROUP_ROWS, GRANULE = 4096, 16
#: Words that a worker's dictionary holds at most, and their characters; bytes of text encoded together.
DICTIONARY, DICTIONARY_CHARS, BLOCK = 800_000, 16_000_000, 6_000_000
#: Partitions whose first copies of a row may meet in one group.
MEETING = 4096
#: Characters that a text is encoded word by word with (Latin letters, digits, marks, plain white space), and the tokenizer's split pattern over these, in lower case.
PLAIN = r"\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-įı-ɏ‐-‧€"
PLAIN_SPLIT = r"[a-zß-öø-ʯⱥⱦ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧€]+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by a byte-level BPE that drops white space, lower-cases, and marks the last letter of a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.other = f"[^{PLAIN}]" + "".join(f"|{re.escape(s)}" for s in special)
        self.split = re.compile(PLAIN_SPLIT).findall
        vocabulary, self.table = table_of(self.tokenizer)
        mark = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"] or ""
        self.inner = np.array([vocabulary[c] for c in byte_letters()], np.int32)
        self.last = np.array([vocabulary[c + mark] for c in byte_letters()], np.int32)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.ids, self.chars = Numbered(), Ragged("<u4"), 0

    def _learn(self, parts: list[str]) -> None:
        """Keeps the ids of parts of texts that have no white space; a part may have several words."""
        words = [w.encode() for w in self.split("\n".join(parts))]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        ids, counts, _ = merged(symbols, sizes, self.table)
        in_part = np.cumsum([len(p.encode()) for p in parts])
        upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(ends, in_part, side="right")]
        self.ids.append(ids, np.diff(upto, prepend=0))
        self.chars += sum(map(len, parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has.

        Texts of plain characters are split at white space, and each different part is merged once; other texts, and those that
        hold a special token, go to the library as a whole."""
        if len(self.numbers) > DICTIONARY or self.chars > DICTIONARY_CHARS:
            self.clear()
        other = pc.match_substring_regex(texts, self.other).to_numpy(zero_copy_only=False).astype(bool)
        found = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(~other))))
        parts = found.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.numbers.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(parts.dictionary))
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new.clear()
        plain, sizes = self.ids.take(numbers[parts.indices.to_numpy()])
        counts = np.zeros(len(texts), np.int64)
        counts[~other] = np.diff(np.concatenate([[0], np.cumsum(sizes)])[found.offsets.to_numpy() - found.offsets[0].as_py()])
        if not other.any():
            return plain, counts
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(texts.filter(pa.array(other)).to_pylist(), add_special_tokens=False)]
        counts[other] = [len(ids) for ids in whole]
        flat = np.empty(int(counts.sum()), "<u4")
        is_plain = np.repeat(~other, counts)
        flat[is_plain], flat[~is_plain] = plain, np.fromiter(chain.from_iterable(whole), "<u4")
        return flat, counts


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2) modulo that of CRC-32; bit 31 is the constant term."""
    product = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            product ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return product


@cache
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    if n_bytes == 0:
        return 1 << 31
    if n_bytes == 1:
        return 1 << 23
    half = _shift(n_bytes // 2)
    return _times(_times(half, half), _shift(n_bytes % 2))


def crc_of_tail(whole: int, head: int, tail_bytes: int) -> int:
    """The CRC-32 of B from those of A + B and of A."""
    return whole ^ _times(_shift(tail_bytes), head)


def balance(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, start in it, length, sequence) of each piece. Items may be cut at multiples of GRANULE."""
    n = max(1, -(-sum(lengths) // size))
    cost, room = np.zeros(n), np.full(n, size)
    todo = [(-length, i, 0) for i, length in enumerate(lengths) if length]
    heapq.heapify(todo)
    placed = []
    while todo:
        less, i, start = heapq.heappop(todo)
        length = -less
        fits = room >= length
        if fits.any():
            k = int(np.where(fits, cost, np.inf).argmin())
        elif (k := int(room.argmax())) is not None and room[k] >= GRANULE:
            head = int(room[k]) // GRANULE * GRANULE
            heapq.heappush(todo, (head - length, i, start + head))
            length = head
        else:
            cost, room, k = np.append(cost, 0.0), np.append(room, size), len(room)
        cost[k] += linear * length + quadratic * length * length
        room[k] -= length
        placed.append((i, start, length, k))
    return placed


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """A row for each piece of docs(doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    groups = max(1, -(-docs.count() // GROUP_ROWS))

    def pieces_of(block: pa.RecordBatch) -> list[tuple]:
        """(row, start, length, crc, doc_tokens, doc_crc, running) of the pieces of each text of a block."""
        flat, counts = encoder(path).encode(block.column(1))
        ends = np.cumsum(counts + 1)
        is_end = np.zeros(int(ends[-1]), bool)
        is_end[ends - 1] = True
        ids = np.full(len(is_end), end_id, "<u4")
        ids[~is_end] = flat
        view, rows = memoryview(ids.tobytes()), []
        for k, (end, n) in enumerate(zip(ends.tolist(), (counts + 1).tolist(), strict=True)):
            own = view[4 * (end - n) : 4 * end]
            crc, whole = zlib.crc32(own), n - n % size
            rows += ((k, s, size, zlib.crc32(own[4 * s : 4 * (s + size)]), n, crc, b"") for s in range(0, whole, size))
            if n > whole:
                running, at = 0, bytearray()
                for s in range(whole, n, GRANULE):
                    running = zlib.crc32(own[4 * s : 4 * min(n, s + GRANULE)], running)
                    at += running.to_bytes(4, "little")
                rows.append((k, whole, n - whole, running, n, crc, bytes(at)))
        return rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies of a row are told apart by number, in whatever order a task meets them, so that they spread over the groups.
        partition, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for block in slices(batch, limit=BLOCK):
                ids, salts = block.column(0).to_pylist(), []
                columns = list(zip(*pieces_of(block), strict=True))
                for k, s, crc in zip(columns[0], columns[1], columns[5], strict=True):
                    if s == 0:
                        nth, met[ids[k], crc] = met[ids[k], crc], met[ids[k], crc] + 1
                        salt = nth << 32 | (partition if nth else partition // MEETING)
                    salts.append(salt)
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary()), pa.array(salts, pa.int64())], ["doc_id", "start", "length", "crc", "doc_tokens", "doc_crc", "running", "salt"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "doc_crc", "start"], ascending=[False, True, True, True], ignore_index=True)
        full = rows.length.to_numpy() == size
        out = [(i, 0, size, i) for i in np.flatnonzero(full)]
        first = len(out)
        out += [(i + first, a, n, k + first) for i, a, n, k in balance(rows.length[~full].tolist(), size, linear, quadratic)]
        crc, running, base = rows.crc.to_numpy(), rows.running.tolist(), rows.start.to_numpy()
        offsets: dict[int, int] = {}
        pieces = []
        for i, a, n, k in out:
            value = int(crc[i])
            if n < rows.length[i]:
                b, words = a + n, np.frombuffer(running[i], "<u4")
                value = int(words[-1] if b == rows.length[i] else words[b // GRANULE - 1])
                if a:
                    value = crc_of_tail(value, int(words[a // GRANULE - 1]), 4 * n)
            at = offsets.get(k, 0)
            offsets[k] = at + n
            pieces.append((i, base[i] + a, n, value, (int(key[0]) << 32) + k, at))
        columns = np.array([p[1:] for p in pieces], dtype=np.int64).reshape(-1, 5)
        at = np.array([p[0] for p in pieces], dtype=np.int64)
        return pd.DataFrame({"doc_id": rows.doc_id.to_numpy()[at], "start": columns[:, 0], "length": columns[:, 1], "ids_crc32": columns[:, 2], "doc_tokens": rows.doc_tokens.to_numpy()[at], "sequence_id": columns[:, 3], "offset": columns[:, 4]})

    pieces = texts(docs).mapInArrow(cut, "doc_id long, start long, length long, crc long, doc_tokens long, doc_crc long, running binary, salt long")
    return pieces.groupBy(F.pmod(F.xxhash64("doc_id", "doc_crc", "salt"), F.lit(groups)).alias("group")).applyInPandas(pack, PIECES)
