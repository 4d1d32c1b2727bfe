"""Texts of one doc_id that a checksum cannot tell apart, and the text that deduplication leaves."""

from __future__ import annotations

import random
import zlib

import numpy as np

from lumensift.llm import suffix_dedup
from tests.llm.test_operators import plain_repeats, same


def with_crc(base: str, places: list[int], want: int) -> str:
    """base with some of its a's as c's, so that its CRC-32, which is affine in the bits of a text, is `want`."""
    start = zlib.crc32(base.encode())
    rows = []
    for i in places:
        flipped = base[:i] + "c" + base[i + 1 :]
        rows.append((zlib.crc32(flipped.encode()) ^ start, {i}))
    basis: dict[int, tuple[int, set[int]]] = {}
    for value, used in rows:
        while value:
            top = value.bit_length()
            if top not in basis:
                basis[top] = (value, used)
                break
            value, used = value ^ basis[top][0], used ^ basis[top][1]
    value, chosen = want ^ start, set()
    while value:
        value, chosen = value ^ basis[value.bit_length()][0], chosen ^ basis[value.bit_length()][1]
    return "".join("c" if i in chosen else c for i, c in enumerate(base))


def test_two_texts_of_one_id_with_one_crc(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("defghij ") for _ in range(120))
    first = "yy" + passage + "yy"
    other = with_crc("a" * 80 + "".join(rng.choice("klmnop") for _ in range(120)), list(range(80)), zlib.crc32(first.encode()))
    assert zlib.crc32(other.encode()) == zlib.crc32(first.encode()) and len(other) == 200
    rows = [(1, passage), (5, first), (5, other)]
    same(suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")), plain_repeats(rows))


def kept_text(pairs, least=50):
    """What is left of each text: bytes that a smaller id has in a run of `least` go, and characters that lose a byte go whole."""
    first: dict[bytes, int] = {}
    order = lambda i: 1 << 63 if i is None else i
    for i, t in pairs:
        raw = (t or "").encode()
        for j in range(len(raw) - least + 1):
            window = raw[j : j + least]
            first[window] = min(first.get(window, 1 << 70), order(i))
    for i, t in pairs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - least + 1):
            if first[raw[j : j + least]] < order(i):
                gone[j : j + least] = True
        out, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not gone[at : at + n].any():
                out.append(c)
            at += n
        yield i, "".join(out)


def test_text_that_is_left(edge, pairs):
    got = sorted(repr((r["doc_id"], r["text"], r["n_chars"])) for r in suffix_dedup.deduplicated(edge).collect())
    assert got == sorted(repr((i, t, len(t))) for i, t in kept_text(pairs))
