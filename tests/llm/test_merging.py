"""Merging of many words at once against the library and against an agenda for each."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lumensift.llm import merging, packing

ODD = ["“It’s” — né¿ × ½ <|endoftext|> a", "  lead trail  ", "don't's l'll", "a'sb 'S 'RE", "xİy", "ȺɁbc ÀÉ", "µ ª", "", "a" * 3000, "x\u00a0y\u2028z", "日本語 text"]


def test_words_are_those_of_the_library():
    encoder = packing.WordEncoder(packing.default_tokenizer())
    rng = random.Random(1)
    letters = "abcȺɁƁXYZ' \n\t.,!?0123éÉßŸƻǅ¡©«±´»¿×÷–’”€-_<|>'srevlmd"
    strings = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for _ in range(2):  # once new, once known
        ids, counts = encoder.encode(pa.array(strings))
        library = encoder.tokenizer.encode_batch(strings, add_special_tokens=False)
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library]
    encoder.chars = packing.DICTIONARY_CHARS + 1  # a full dictionary is emptied
    again, _ = encoder.encode(pa.array(strings))
    assert (again == ids).all()


def test_together_and_by_agenda(monkeypatch):
    encoder = packing.encoder(packing.default_tokenizer())
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdest") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    parts = [encoder.inner[np.frombuffer(w.encode(), np.uint8)] for w in words]
    sizes, keys = np.array([len(p) for p in parts]), np.arange(len(words)) * 7919

    def dropped(these, step):
        return ((keys[these] + step * 31) * 2654435761 >> 7) % 10 < 3

    for skip in (None, dropped):
        together = merging.merged(np.concatenate(parts), sizes, encoder.table, skip)
        with monkeypatch.context() as m:
            m.setattr(merging, "WIDTHS", (2,))
            alone = merging.merged(np.concatenate(parts), sizes, encoder.table, skip)
        assert all((a == b).all() for a, b in zip(together, alone, strict=True))


def test_pair_table_finds_all_and_nothing_else():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    table = merging.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)), np.arange(len(pairs)) + 7)
    left, right = np.divmod(np.arange(300 * 300), 300)
    found = table.find(left.astype(np.int32), right.astype(np.int32))
    have = {(a, b): i << 32 | i + 7 for i, (a, b) in enumerate(pairs.tolist())}
    assert found.tolist() == [have.get(x, np.iinfo(np.int64).max) for x in zip(left.tolist(), right.tolist(), strict=True)]
    assert (table.find(np.array([-1, 5], np.int32), np.array([5, -1], np.int32)) == np.iinfo(np.int64).max).all()
