"""Held-out accuracy, and every edge case."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lumensift.llm import quality_classifier, toxicity
from lumensift.llm.queries import QUERIES
from lumensift.llm.subwords import labelled_sample, ngram_buckets

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.9)])
def test_held_out(spark, name, label, least):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.3 if label == "quality" else 0.5)) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in out]) >= least


@pytest.mark.parametrize("score", [quality_classifier.quality_scores, toxicity.toxicity_scores])
def test_edges(spark, edge, pairs, score):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (8, 0, 1), (12, 1, 0), (None, 1, 1), (7, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = score(edge, labels).collect()
    assert len(rows) == len(pairs) and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_text[1] == by_text[2] and by_text[4] == by_text[5]
    assert {r["score"] for r in score(edge, labels.limit(0)).collect()} == {0.5}
    assert score(edge.limit(0), labels).count() == 0


def test_sample_is_bounded_and_not_held_out(spark, edge):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)], "doc_id long, toxic int")
    sample = list(labelled_sample(edge, labels, "toxic", 4, 10**9))
    assert 0 < len(sample) <= 4
    assert not list(labelled_sample(edge, labels, "toxic", 4, 0)) or all(t == "" for t, _ in labelled_sample(edge, labels, "toxic", 4, 0))


def test_sample_skips_texts_that_do_not_fit(spark):
    """One too long text, wherever it comes, costs only itself, and both labels get rows."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, int(k % 4 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    for long in ids[:12]:
        docs = spark.createDataFrame([(i, "x" * (5000 if i == long else 10)) for i in ids], "doc_id long, text string")
        assert sorted(len(t) for t, _ in labelled_sample(docs, labels, "toxic", 100, 1000)) == [10] * (len(ids) - 1)
    docs = spark.createDataFrame([(i, "x" * (90 if k % 4 == 0 else 300)) for k, i in enumerate(ids)], "doc_id long, text string")
    sample = list(labelled_sample(docs, labels, "toxic", 100, 1000))
    assert {y for _, y in sample} == {0, 1} and sum(len(t) for t, _ in sample) <= 1000


@pytest.mark.parametrize(("n", "toxic", "rare"), [(68, 10, 4), (900, 300, 6)])
def test_rare_abuse_words(n, toxic, rare):
    """Few labels, and a word in few toxic documents and in no clean one, still make a model."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    sample = [(" ".join(rng.choice(words, 30)) + (" zyxwvq" if k < rare else ""), int(k < toxic)) for k in range(n)]
    weights, bias = toxicity.train(sample)
    scorer = toxicity.Scorer(weights.tobytes(), bias)
    plain = " ".join(rng.choice(words, 30))
    with_, without = scorer.score([plain + " zyxwvq", plain])
    assert with_ > without + 0.05


def test_ngrams():
    words = ["ab", "abc", "", "xabc"]
    buckets, begins = ngram_buckets(words, 2, 3, 20, whole=True)
    sizes = np.diff(begins).tolist()
    assert sizes == [1 + 3 + 2, 1 + 4 + 3, 1 + 1, 1 + 5 + 4]
    again, _ = ngram_buckets(["abc"], 2, 3, 20, whole=True)
    assert again.tolist() == buckets[begins[1] : begins[2]].tolist()
