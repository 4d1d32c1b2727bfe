"""A toxicity classifier: character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams of a document's different words (lower case), each counted once for a word.
The log-count ratio of a bucket compares its share of the toxic and of the other training documents. A linear model is trained on features times ratios, by full-batch gradient
descent with momentum on the logistic loss. Ratios within chance of 0 count as 0.

A document's log-odds are a sum over its different words, so a worker keeps one number for each word it has met. Fitted on a
bounded sample (SAMPLE_ROWS and SAMPLE_BYTES).

Null or empty text: the bias alone. Null doc_id: scored, never learned from. Repeated rows have equal scores. Without any labels the score is 0.5.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumensift.llm.common import held_out, map_blocks, texts
from lumensift.llm.subwords import labelled_sample, ngram_buckets, segment_sums

#: Labelled rows and bytes of text that a model is fitted on, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 24_000_000
BITS, LOW, HIGH = 17, 3, 5
SMOOTHING, PENALTY, STEPS = 1.0, 1e-4, 120
#: Standard errors that a log-count ratio must differ from 0 by; others count as 0.
SIGNIFICANT = 1.5
DICTIONARY, LONGEST = 800_000, 64
WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> set[str]:
    return set(WORDS(text.lower()))


def train(sample: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """(a weight for each bucket, a bias)."""
    width = 1 << BITS
    labels = np.array([y for _, y in sample], np.float64)
    if len(set(labels.tolist())) < 2:
        return np.zeros(width, np.float32), 0.0
    names: dict[str, int] = {}
    docs = [np.array([names.setdefault(w, len(names)) for w in words_of(text)], np.int64) for text, _ in sample]
    buckets, begins = ngram_buckets(list(names), LOW, HIGH, BITS)
    sizes = np.diff(begins)

    def counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a document, and of how many of its words each is."""
        n = sizes[words]
        at = np.concatenate([[0], np.cumsum(n)])
        return np.unique(buckets[np.repeat(begins[words] - at[:-1], n) + np.arange(at[-1])], return_counts=True)

    p, q = np.full(width, SMOOTHING), np.full(width, SMOOTHING)
    for words, y in zip(docs, labels, strict=True):
        (p if y else q)[counted(words)[0]] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    ratio = np.log((p / (n1 + 2 * SMOOTHING)) / (q / (n0 + 2 * SMOOTHING)))
    ratio[np.abs(ratio) < SIGNIFICANT * np.sqrt(1 / p + 1 / q)] = 0  # else the noise of very many words outweighs a long document's few toxic ones
    columns, values, edges = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [0]
    for words in docs:  # once more, as only what the ratios leave is kept
        found, count = counted(words)
        use = ratio[found] != 0
        columns.append(found[use])
        values.append(count[use])
        edges.append(edges[-1] + int(use.sum()))
    column, value, edge = np.concatenate(columns), np.concatenate(values).astype(np.float32), np.array(edges)
    row = np.repeat(np.arange(len(docs)), np.diff(edge))
    scaled = value * ratio[column].astype(np.float32)
    weight, speed = np.zeros(width), np.zeros(width)
    bias = drift = 0.0
    balance = np.where(labels == 1, 0.5 * len(labels) / n1, 0.5 * len(labels) / n0)
    norm = np.sqrt(np.bincount(row, scaled.astype(np.float64) ** 2, len(docs)).mean() + 1)
    rate = 4.0 / norm
    for step in range(STEPS):
        margin = segment_sums((scaled * weight[column]).astype(np.float64), edge) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) / len(labels)
        slope = np.bincount(column, scaled * error[row], width) + PENALTY * weight
        keep = 0.9 if step else 0.0
        speed = keep * speed - rate * slope
        drift = keep * drift - 0.5 * error.sum()
        weight += speed
        bias += drift
    return (weight * ratio).astype(np.float32), bias


class Scorer:
    def __init__(self, weights: bytes, bias: float):
        self.weights, self.bias = np.frombuffer(weights, np.float32), bias
        self.known: dict[str, float] = {}

    def score(self, strings: list[str]) -> np.ndarray:
        sets = [words_of(t) for t in strings]
        known = self.known
        missing = list({w for s in sets for w in s if w not in known})
        if len(known) + len(missing) > DICTIONARY:
            known.clear()
            missing = list(set().union(*sets))
        buckets, begins = ngram_buckets(missing, LOW, HIGH, BITS)
        known.update(zip(missing, segment_sums(self.weights[buckets].astype(np.float64), begins).tolist(), strict=True))
        # in sorted order, so that equal texts have equal sums
        margin = np.array([self.bias + sum(sorted(map(known.__getitem__, s))) for s in sets])
        for w in missing:
            if len(w) > LONGEST:
                del known[w]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


@cache
def scorer(weights: bytes, bias: float) -> Scorer:
    return Scorer(weights, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Fits on docs(doc_id, text, ...) with labels(doc_id, toxic), then: doc_id, held_out, score and predicted (1 if score >= threshold) for each row."""
    weights, bias = train(list(labelled_sample(docs, labels, "toxic", rows, most_bytes)))
    raw = weights.tobytes()

    def work(block: pa.RecordBatch, strings: list[str]) -> pa.RecordBatch:
        score = scorer(raw, bias).score(strings)
        return pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_blocks(texts(docs, held_out(docs["doc_id"]).alias("held_out")), "doc_id long, held_out boolean, score double, predicted int", work)
