"""Codes and codebooks against plain integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lumensift.llm import vector_codes
from lumensift.llm.vector_codes import codes, decoded

MOST = 2**63 - 1


def plain(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label)."""
    good = [(i, [math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in good), default=0)
    width += -width % 4
    good = [(i, v + [0] * (width - len(v)), label) for i, v, label in good]
    n = width // 4
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    def part(v, p):
        return v[p * n : (p + 1) * n]

    def far(x, c):
        return sum((a - b) * (a - b) for a, b in zip(x, c, strict=True))

    books = [[part(v, p) for _, v, _ in good[:entries]] for p in range(4)]
    for step in range(rounds + 1):
        near = [[min((far(part(v, p), c), e) for e, c in enumerate(books[p])) for p in range(4)] for _, v, _ in good]
        if step == rounds:
            break
        for p in range(4):
            of = defaultdict(list)
            for (_, v, _), best in zip(good, near, strict=True):
                of[best[p][1]].append(part(v, p))
            for e, own in of.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    errors, sums = [min(MOST, sum(d for d, _ in best)) for best in near], defaultdict(int)
    for (_, _, label), e in zip(good, errors, strict=True):
        sums[label] += e
    return [(i, "".join(f"{e:02x}" for _, e in best), e, min(MOST, sums[label]), digest) for (i, _, label), best, e in zip(good, near, errors, strict=True)]


def same(df, rows):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, of string").repartition(3)


def made(n, width, seed, scale=1.0):
    rng = random.Random(seed)
    return [(rng.randint(-n, 4 * n), [rng.gauss(0, 0.1) * scale for _ in range(width)], rng.choice([None, 1, 1, 1, 2])) for _ in range(n)]


def test_codes(spark):
    rows = made(400, 8, 1)
    rows += [(7, rows[0][1], None), rows[3], rows[3], (None, rows[4][1], 2), (None, [0.0] * 8, 5)]  # repeated ids, rows and vectors
    rows += [(1, None, 1), (2, [None] + [0.5] * 7, 1), (3, [float("nan")] + [0.5] * 7, 1), (4, [float("inf")] * 8, 1), (5, [float("-inf")] + [0.0] * 7, None)]
    same(codes(frame(spark, rows)), plain(rows))


def test_ties(spark):
    """Vectors of few values: many equal distances and unused entries."""
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1, 0, 1]) / 1024 for _ in range(4)], k % 3) for k in range(500)]
    same(codes(frame(spark, rows)), plain(rows))


def test_few_rows_and_odd_lengths(spark):
    rows = [(3, [0.1, -0.2, 0.3], 1), (1, [0.5], 1), (2, [], None), (9, [0.1, -0.2, 0.3, 0.0, 1.0], 1)]
    same(codes(frame(spark, rows)), plain(rows))
    same(codes(frame(spark, [(1, [], 1), (2, [], None)])), plain([(1, [], 1), (2, [], None)]))


def test_large_components(spark):
    """Components beyond 64-bit products, and beyond any float product."""
    rows = made(40, 4, 3) + made(20, 4, 4, 1e9) + [(1000, [1e38, -1e38, 3.0, -0.0], 1), (1001, [1.7e308, 1.0, 2.0, -1.7e308], None)]
    same(codes(frame(spark, rows)), plain(rows))


def test_empty(spark):
    assert codes(frame(spark, [(1, [1.0], 1)]).limit(0)).collect() == []
    assert codes(frame(spark, [(1, None, 1)])).collect() == []


def test_floats_floor(spark):
    rows = [(k, [np.float32(x).item() for x in (-0.0001, 0.00097656, -1.0, 0.3 * k)], None) for k in range(30)]
    same(codes(frame(spark, rows, "float")), plain(rows))


@pytest.mark.parametrize("rounds", [0, 1])
def test_rounds(spark, rounds):
    rows = made(300, 4, 6)
    same(codes(frame(spark, rows), rounds), plain(rows, rounds=rounds))


def test_decoded(spark):
    books = [np.arange(6).reshape(3, 2) + 10 * p for p in range(4)]
    got = decoded(spark.createDataFrame([(1, "00010200"), (2, "02020202")], "vec_id long, code string"), books).collect()
    assert got[0].vector == [(x + 0.5) / 1024 for x in (0, 1, 12, 13, 24, 25, 30, 31)] and len(got[1].vector) == 8
    assert vector_codes.PARTS == 4
