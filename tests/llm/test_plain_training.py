"""Both classifiers against plain training loops on a few texts."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from lumensift.llm import quality_classifier, toxicity

MASK = 2**64 - 1
ODD = 0x9E3779B97F4A7C15


def bucket(value, salt, bits):
    value = ((value ^ salt) * 0xBF58476D1CE4E5B9) & MASK
    value = ((value ^ (value >> 29)) * 0x94D049BB133111EB) & MASK
    return value >> (64 - bits)


def ngrams(word, low, high, bits, whole):
    chars, out = [ord(c) for c in f"\x02{word}\x03"], []
    if whole:
        out.append(bucket(sum(c * pow(ODD, i, 1 << 64) for i, c in enumerate(chars)) & MASK, 1, bits))
    for n in range(low, high + 1):
        for a in range(len(chars) - n + 1):
            value = 0
            for c in chars[a : a + n]:
                value = (value * ODD + c) & MASK
            out.append(bucket(value, n, bits))
    return out


def sample(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    out = []
    for k in range(n):
        text = " ".join(rng.choices(words[: 25 if k % 2 else 40], k=rng.randint(0, 12)) + (["zq", "zqx"] if k % 3 == 0 else []))
        out.append((text, int(k % 3 == 0)))
    return out


def plain_toxicity(rows, tests):
    docs = [Counter(b for w in set(t.lower().split()) for b in ngrams(w, 3, 5, 17, False)) for t, _ in rows]
    p, q = Counter(), Counter()
    for d, (_, y) in zip(docs, rows, strict=True):
        for b in d:
            (p if y else q)[b] += 1
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    ratio = {}
    for b in {*p, *q}:
        r = math.log((p[b] + 1) / (n1 + 2)) - math.log((q[b] + 1) / (n0 + 2))
        if abs(r) >= 1.5 * math.sqrt(1 / (p[b] + 1) + 1 / (q[b] + 1)):
            ratio[b] = r
    scaled = [{b: float(np.float32(n) * np.float32(ratio[b])) for b, n in d.items() if b in ratio} for d in docs]
    norm = math.sqrt(sum(x * x for d in scaled for x in d.values()) / len(rows) + 1)
    weight, speed, bias, drift = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for step in range(120):
        errors = []
        for d, (_, y) in zip(scaled, rows, strict=True):
            margin = sum(x * weight[b] for b, x in d.items()) + bias
            errors.append(0.5 * len(rows) / (n1 if y else n0) * (1 / (1 + math.exp(-margin)) - y) / len(rows))
        slope = {b: 1e-4 * weight[b] for b in ratio}
        for d, e in zip(scaled, errors, strict=True):
            for b, x in d.items():
                slope[b] += x * e
        keep = 0.9 if step else 0.0
        for b in ratio:
            speed[b] = keep * speed[b] - 4.0 / norm * slope[b]
            weight[b] += speed[b]
        drift = keep * drift - 0.5 * sum(errors)
        bias += drift
    return [1 / (1 + math.exp(-(bias + sum(weight[b] * ratio[b] for w in set(t.lower().split()) for b in ngrams(w, 3, 5, 17, False) if b in ratio)))) for t in tests]


def test_toxicity():
    rows, tests = sample(1, 50), [t for t, _ in sample(2, 20)] + [""]
    weights, bias = toxicity.train(rows)
    got = toxicity.Scorer(weights.tobytes(), bias).score(tests)
    want = plain_toxicity(rows, tests)
    assert np.allclose(got, want, atol=1e-6) and max(want) > 0.6 > 0.4 > min(want)


def words_of(text):
    words = text.split()
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return counts | Counter({"\x01again": again}) if again else counts


def plain_quality(rows, tests):
    rng = np.random.default_rng(0)
    table = ((rng.random((1 << 17, 8), np.float32) - 0.5) / 8).astype(np.float64)
    output, bias = np.zeros((8, 2)), np.zeros(2)
    of_word = lambda w: ngrams(w, 2, 4, 17, True)
    docs = [Counter(b for w, n in words_of(t).items() for b in of_word(w) * n) for t, _ in rows]
    passes = -(-len(rows) // 32)
    epochs = max(6, -(-600 // passes))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 32):
            chosen = order[a : a + 32]
            rate = 2.0 * (1 - step / (epochs * passes))
            step += 1
            moved_output, moved_bias, moved = np.zeros((8, 2)), np.zeros(2), {}
            for i in chosen:
                d, y = docs[i], rows[i][1]
                total = max(1, sum(d.values()))
                mean = sum((n * table[b] for b, n in d.items()), np.zeros(8)) / total
                logits = mean @ output + bias
                chance = np.exp(logits - logits.max())
                chance /= chance.sum()
                chance[y] -= 1
                moved_output += np.outer(mean, chance)
                moved_bias += chance
                back = output @ chance / total
                for b, n in d.items():
                    moved[b] = moved.get(b, 0) + n * back
            for b, x in moved.items():
                table[b] -= rate * x
            output -= rate / len(chosen) * moved_output
            bias -= rate / len(chosen) * moved_bias
    slope, out = output[:, 1] - output[:, 0], []
    for t in tests:
        d = Counter(b for w, n in words_of(t).items() for b in of_word(w) * n)
        out.append(1 / (1 + math.exp(-(bias[1] - bias[0] + sum(n * (table[b] @ slope) for b, n in d.items()) / max(1, sum(d.values()))))))
    return out


def test_quality():
    rows, tests = sample(3, 34), [t for t, _ in sample(4, 20)] + ["", "ab ab ab"]
    weights, bias = quality_classifier.train(rows)
    got = quality_classifier.Scorer(weights.tobytes(), bias).score(tests)
    want = plain_quality(rows, tests)
    assert np.allclose(got, want, atol=1e-6) and max(want) > 0.6 > 0.4 > min(want)
