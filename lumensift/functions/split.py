"""Words of texts inside tasks: Arrow batches of texts in, batches of words out.

The words are those of text.raw_words(). A text's words are found and counted at once, so that rows of words need no aggregation (which took eight times as long)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex

from lumensift.functions import text as X
from lumensift.functions.stopwords import STOP_WORDS

#: Texts that are Python strings at a time.
TEXTS = 256
#: Words that a task holds with their first places.
WORDS = 200_000
FIRSTS = "word string, doc_idx bigint, place bigint"
COUNTS = "word string, doc_idx bigint, title int, keywords int, body int, place bigint"
_found = regex.compile(X.WORD).findall


def words(text: str | None) -> list[str]:
    """All words of a text, in lower case, stop words included."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text)
    return [w.lower() for w in _found(text)] if "İ" in text else _found(text.lower())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            yield zip(*(c.to_pylist() for c in batch.slice(start, TEXTS).columns), strict=True)


def _places(found: list[list[str]]) -> dict[str, int]:
    """The first place of each word of title, keywords and body."""
    first: dict[str, int] = {}
    for field in (2, 1, 0):  # the first place is written last
        first.update(zip(reversed(found[field]), range((field << 32) + len(found[field]) - 1, (field << 32) - 1, -1), strict=True))
    return first


def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FIRSTS of (doc_idx, title, keywords_text, content): for each indexed word of a batch the least document and its first place there."""
    docs: dict[str, int | None] = {}
    places: dict[str, int] = {}

    def taken() -> pa.RecordBatch:
        own = [w for w in docs if w not in STOP_WORDS]
        columns = [pa.array(own, pa.string()), pa.array(map(docs.__getitem__, own), pa.int64()), pa.array(map(places.__getitem__, own), pa.int64())]
        docs.clear()
        places.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "doc_idx", "place"])

    for batch in batches:
        # the least document is written last; those without a number come first
        order = pc.array_sort_indices(batch.column(0), order="descending", null_placement="at_start")
        for start in range(0, batch.num_rows, TEXTS):
            for doc_idx, *texts in zip(*(c.to_pylist() for c in batch.take(order.slice(start, TEXTS)).columns), strict=True):
                first = _places([words(t) for t in texts])
                docs.update(dict.fromkeys(first, doc_idx))
                places.update(first)
            if len(docs) > WORDS:
                yield taken()
        if docs:
            yield taken()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of (doc_idx, title, keywords_text, content): a row for each indexed word of a document, with its first place (see index.py)."""
    for rows in _rows(batches):
        said, docs, tf, places = [], [], ([], [], []), []
        for doc_idx, *texts in rows:
            found = [words(t) for t in texts]
            first = _places(found)
            own = [w for w in first if w not in STOP_WORDS]
            said += own
            docs += [doc_idx] * len(own)
            places += map(first.__getitem__, own)
            for to, said_here in zip(tf, map(Counter, found), strict=True):
                to += [said_here.get(w, 0) for w in own] if said_here else [0] * len(own)
        columns = [pa.array(said, pa.string()), pa.array(docs, pa.int64()), *(pa.array(x, pa.int32()) for x in tf), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["word", "doc_idx", "title", "keywords", "body", "place"])


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_idx, doc_len) of (doc_idx, content): the indexed words of each text."""
    for rows in _rows(batches):
        docs, texts = zip(*rows, strict=True)
        sizes = [sum(w not in STOP_WORDS for w in words(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64())], ["doc_idx", "doc_len"])


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, doc_idx, at) of (doc_idx, title, content): each place of an indexed word, from 0 over title and content."""
    for rows in _rows(batches):
        said, docs, at = [], [], []
        for doc_idx, title, content in rows:
            own = [(w, i) for i, w in enumerate(words(title) + words(content)) if w not in STOP_WORDS]
            said += [w for w, _ in own]
            at += [i for _, i in own]
            docs += [doc_idx] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(docs, pa.int64()), pa.array(at, pa.int32())], ["word", "doc_idx", "at"])
