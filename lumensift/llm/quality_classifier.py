"""A quality classifier with supervised subword embeddings.

Learned vectors of hashed words and of their character n-grams are averaged over a document, and a softmax over the average
gives the score. Vectors and output are trained by stochastic gradient descent in numpy on a bounded sample (SAMPLE_ROWS
and SAMPLE_BYTES). A word that repeats the one before it counts as one further word, AGAIN, so that stammering text differs from prose.

The score of a document is linear in its features before the softmax, so a worker keeps one sum for each word it has met.

Null or empty text: no features; the score is that of the output's bias alone. Null doc_id: scored, never learned from. Repeated rows
have equal scores. Without any labels the score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumensift.llm.common import held_out, map_blocks, texts
from lumensift.llm.subwords import labelled_sample, ngram_buckets, segment_sums

#: Labelled rows and bytes of text that a model is fitted on, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16_000_000
BITS, DIMENSION, LOW, HIGH = 17, 8, 2, 4
#: Steps of training, at least; over a large sample, so many passes at least.
STEPS, EPOCHS, BATCH, RATE = 600, 6, 32, 2.0
DICTIONARY, LONGEST = 600_000, 64
AGAIN = "\x01again"


def words_of(text: str) -> Counter:
    words = text.split()
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if again:
        counts[AGAIN] = again
    return counts


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return ngram_buckets(words, LOW, HIGH, BITS, whole=True)


def train(sample: list[tuple[str, int]], seed: int = 0) -> tuple[np.ndarray, float]:
    """(a weight for each bucket, a bias): the log-odds of label 1 are the bias and the mean of a document's weights."""
    rng = np.random.default_rng(seed)
    table = ((rng.random((1 << BITS, DIMENSION), np.float32) - 0.5) / DIMENSION).astype(np.float32)
    output = np.zeros((DIMENSION, 2), np.float32)
    bias = np.zeros(2, np.float32)
    if not sample:
        return np.zeros(1 << BITS, np.float32), 0.0
    names: dict[str, int] = {}
    docs = []
    for text, _ in sample:
        counts = words_of(text)
        docs.append((np.array([names.setdefault(w, len(names)) for w in counts], np.int64), np.array(list(counts.values()), np.float32)))
    labels = np.array([y for _, y in sample])
    buckets, begins = features(list(names))
    sizes = np.diff(begins)
    a_pass = -(-len(docs) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // a_pass))
    steps, step = epochs * a_pass, 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            doc_words = np.concatenate([docs[i][0] for i in chosen])
            counts = np.concatenate([docs[i][1] for i in chosen])
            edges = np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in chosen])])
            words, place = np.unique(doc_words, return_inverse=True)
            n = sizes[words]
            at = np.concatenate([[0], np.cumsum(n)])
            used = buckets[np.repeat(begins[words] - at[:-1], n) + np.arange(at[-1])]
            vectors = segment_sums(table[used], at)
            total = np.maximum(segment_sums(counts * n[place], edges), 1)
            mean = segment_sums(vectors[place] * counts[:, None], edges) / total[:, None]
            logits = mean @ output + bias
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(chosen)), labels[chosen]] -= 1
            back = (chance @ output.T) / total[:, None]
            output -= rate / len(chosen) * (mean.T @ chance)
            bias -= rate / len(chosen) * chance.sum(axis=0)
            of = np.repeat(np.arange(len(chosen)), np.diff(edges))
            share = np.empty((len(words), DIMENSION), np.float32)
            for d in range(DIMENSION):
                share[:, d] = np.bincount(place, back[of, d] * counts, len(words))
            unique, where = np.unique(used, return_inverse=True)
            word_of = np.repeat(np.arange(len(words)), n)
            for d in range(DIMENSION):
                table[unique, d] -= rate * np.bincount(where, share[word_of, d], len(unique)).astype(np.float32)
    slope = output[:, 1] - output[:, 0]
    return (table @ slope).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, weights: bytes, bias: float):
        self.weights, self.bias = np.frombuffer(weights, np.float32), bias
        self.known: dict[str, tuple[float, int]] = {}

    def score(self, strings: list[str]) -> list[float]:
        counts = [words_of(t) for t in strings]
        known = self.known
        missing = list({w for c in counts for w in c if w not in known})
        if len(known) + len(missing) > DICTIONARY:
            known.clear()
            missing = list({w for c in counts for w in c})
        buckets, begins = features(missing)
        known.update(zip(missing, zip(segment_sums(self.weights[buckets].astype(np.float64), begins).tolist(), np.diff(begins).tolist(), strict=True), strict=True))
        out = []
        for c in counts:
            total = size = 0.0
            for w, n in c.items():
                s, k = known[w]
                total += n * s
                size += n * k
            out.append(1 / (1 + np.exp(-(self.bias + total / max(size, 1)))))
        for w in missing:
            if len(w) > LONGEST:
                del known[w]
        return out


@cache
def scorer(weights: bytes, bias: float) -> Scorer:
    return Scorer(weights, bias)


def scored(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) for each row."""
    raw = weights.tobytes()

    def work(block: pa.RecordBatch, strings: list[str]) -> pa.RecordBatch:
        score = np.array(scorer(raw, bias).score(strings), np.float64)
        return pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_blocks(texts(docs, held_out(docs["doc_id"]).alias("held_out")), "doc_id long, held_out boolean, score double, predicted int", work)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Fits on docs(doc_id, text, ...) with labels(doc_id, quality), then scores every row."""
    weights, bias = train(list(labelled_sample(docs, labels, "quality", rows, most_bytes)))
    return scored(docs, weights, bias, threshold)
