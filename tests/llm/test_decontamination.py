"""Search for benchmark windows against a plain comparison of words."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest

from lumensift.llm import decontamination
from lumensift.llm.decontamination import Windows, Words, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(pairs, items):
    windows: dict[tuple, set[str]] = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    for i, text in pairs:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (own := windows.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    found |= own
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def same(df, rows):
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))


def made(seed, n=60):
    """Documents and items of few words, so that windows overlap, repeat, and are parts of others."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "The", "thé", "ÉTÉ", "été", "日本", "x1", "longerword" * 3, "q" * 80, "İ"]
    gaps = [" ", "  ", "\n", ", ", "-", "\x00", "\t"]

    def text(size):
        return "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(size))

    items = [(k if k % 7 else None, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 14, 30]))) for k in range(n)]
    items += [(3, items[4][1]), (10, items[5][1]), (5, None), (2, "!!")]
    docs = [(k, text(rng.randint(0, 30)) + rng.choice(items[:n])[1][: rng.choice([5, 500])] + text(rng.randint(0, 9))) for k in range(n)]
    return [*docs, (None, docs[0][1]), (1, docs[0][1]), (2, None), (3, "")], items


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    docs, items = made(seed)
    left = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, item string, row string").repartition(3)
    right = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    want = list(plain(docs, items))
    same(contamination(left, right), want)
    if seed == 1:
        same(contamination(left, right, portion=3000), want)


def test_long_items_alone(spark):
    """Items of ten words or more, so the search moves on over many bytes."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 12))) for _ in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(10, 40)))) for k in range(80)]
    docs = []
    for k in range(200):
        w = rng.choices(vocabulary, k=rng.randint(0, 400))
        if k % 2:
            own = rng.choice(items)[1].split()
            a = rng.randint(0, len(own))
            w[5:5] = own[a : a + rng.randint(5, 20)]
        docs.append((k, " ".join(w)))
    want = list(plain(docs, items))
    assert 30 < sum(r[5] for r in want) < 120
    same(contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), want)


def test_edges(spark, edge, pairs):
    items = [(1, pairs[0][1][:400]), (2, "quick brown"), (3, pairs[13][1][50_000:60_000])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    short = [(i, t if t is None or len(t) < 5000 else None) for i, t in pairs]
    got = {(r.doc_id, r.n_words): r for r in contamination(edge, benchmark).collect()}
    for row in plain(short, items):
        if row[1]:
            assert tuple(got[row[:2]]) == row
    assert contamination(edge.limit(0), benchmark).count() == 0
    none = contamination(edge, benchmark.limit(0)).collect()
    assert len(none) == len(pairs) and not any(r.contaminated or r.n_items for r in none)


def test_cut_items(monkeypatch):
    """Segments of a long item have its windows, and no others."""
    monkeypatch.setattr(decontamination, "SEGMENT", 60)
    docs, items = made(4)
    batch = pa.RecordBatch.from_arrays([pa.array([None if i is None else str(i) for i, _ in items]), pa.array([t or "" for _, t in items])], ["item", "text"])
    cut = [(r["item"], r["words"], r["whole"]) for b in decontamination._segments([batch]) for r in b.to_pylist()]
    assert len(cut) > len(items)
    windows = Windows(cut)
    text = Words(pa.array([t or "" for _, t in docs]))
    first, _, window = windows.hits(text)
    found = dict(windows.items_of(text, first, window))
    for k, row in enumerate(plain(docs, items)):
        assert len(found.get(k, [])) == row[3]


def test_moves():
    """Blocks that no window has let the search move on by nearly a window's length."""
    windows = Windows([("1", " ".join(f"word{k}" for k in range(12)), True)])
    assert [c.moves.max() > 40 for c in windows.classes] == [True]
