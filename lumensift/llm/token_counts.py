"""Token counts without ids.

Count pieces once per distinct pre-token, join to per-document pre-token frequencies, and sum.

A document is reduced to the frequencies of its pre-tokens. A worker keeps a dictionary from pre-token to number of
pieces; only pre-tokens that are not in it are merged by the tokenizer's rules, all those of a block together. The join of the two is
a dictionary look-up in the task, so nothing is shuffled: a join of (document, pre-token) rows across tasks would move
more bytes than the texts have, and gain only that a pre-token is counted once in the cluster instead of once in a worker.

Null text: empty, no tokens. Repeated rows, null doc_id: each row is counted. Very long texts: a block of their own.
Strings of special tokens inside a text are one token each, which is the library's default.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumensift.llm.common import map_blocks, texts
from lumensift.llm.merging import byte_letters, merged, table_of

#: Entries of a worker's dictionary, and the longest pre-token that is kept in it.
DICTIONARY = 1_000_000
LONGEST = 48

#: The same over texts of these characters alone, for the faster `re`. Other texts are split by the tokenizer's own splitter.
PLAIN = r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*"
PLAIN_SPLIT = r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[!-/:-@\[-`{-~]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceCounter:
    """Numbers of pieces by a byte-level BPE of the `tokenizers` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = re.compile(PLAIN_SPLIT).findall
        self.plain = re.compile(PLAIN).fullmatch
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))).split if special else lambda text: [text]
        vocabulary, self.table = table_of(self.tokenizer)
        self.letters = np.array([vocabulary[c] for c in byte_letters()], np.int32)
        self.pieces: dict[str, int] = {}

    def pretokens(self, part: str) -> list[str]:
        if self.plain(part):
            return self.split(part)
        return [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]

    def learn(self, missing: list[str]) -> dict[str, int]:
        """Piece counts of pre-tokens that the dictionary lacks. Those too long to be kept are in the result alone."""
        raw = [w.encode("utf-8", "surrogatepass") for w in missing]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        _, counts, _ = merged(self.letters[np.frombuffer(b"".join(raw), np.uint8)], sizes, self.table)
        found = dict(zip(missing, counts.tolist(), strict=True))
        if len(self.pieces) + len(found) > DICTIONARY:
            self.pieces.clear()
        self.pieces.update((w, n) for w, n in found.items() if len(w) <= LONGEST)
        return found

    def count(self, strings: list[str]) -> list[int]:
        """Tokens of each text."""
        specials, frequencies = [], []
        for text in strings:
            parts = self.special(text)
            specials.append(len(parts) - 1)
            frequencies.append(Counter(self.pretokens(parts[0])) if len(parts) == 1 else Counter(w for p in parts for w in self.pretokens(p)))
        known = self.pieces
        missing = list({w for f in frequencies for w in f if w not in known})
        if missing:
            held = dict(known) if len(known) + len(missing) > DICTIONARY else known  # learn() may empty the dictionary
            known = _Either(held, self.learn(missing))
        return [s + sum([known[w] * n for w, n in f.items()]) for s, f in zip(specials, frequencies, strict=True)]


class _Either(dict):
    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key):
        return self.first[key]


@cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs(doc_id, text, ...)."""
    path = tokenizer or default_tokenizer()

    def work(block: pa.RecordBatch, strings: list[str]) -> pa.RecordBatch:
        tokens = pa.array(counter(path).count(strings), pa.int64())
        return pa.RecordBatch.from_arrays([block.column(0), pc.cast(pc.binary_length(block.column(1)), pa.int64()), tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_blocks(texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)
