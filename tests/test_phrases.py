"""Phrases through the places of words against a substring test of all texts."""

from __future__ import annotations

import random

import pytest

from lumensift.operators import phrases
from lumensift.operators.index import SearchIndex, build
from lumensift.operators.search import search
from lumensift.schema import DOC
from lumensift.sources import corpora

TEXTS = [
    ("Quick start", "Run the quick-start guide, then restart. The end_of story -foo bar"),
    ("The quick", "start of it: x-foo bar; foo--bar"),
    ("", "ﬁne print and naïve café texts"),
    ("Istanbul İstanbul", "the of and"),
    ("Поиск слов", "поисковый запрос: «точная фраза»"),
    ("a", "b"),
]


@pytest.fixture(scope="module")
def saved(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("phrases"))
    rows = [(10**6 + i, str(10**6 + i), t, c, None, None, None, None, None) for i, (t, c) in enumerate(TEXTS)]
    docs = corpora.documents(spark, sf_dir)
    docs = docs.unionByName(spark.createDataFrame(rows, DOC)).persist()
    build(docs).persist().save(path, positions=True)
    yield SearchIndex.load(spark, path), {r["doc_idx"]: f"{r['title']} {r['content']}".lower() for r in docs.collect()}
    docs.unpersist()


def test_candidates_hold_all_matches(saved):
    index, hay = saved
    rng = random.Random(6)
    cut = ["quick start", "start", "uick sta", "the quick start", "foo bar", "-foo bar", "o--b", "of", "the of", "fine print", "cafe", "end_of", "of story", ": x", "точная фраза", "азы", "istanbul", "a b", "!!"]
    texts = [t for t in hay.values() if len(t) > 200]
    for _ in range(40):
        text = rng.choice(texts)
        a = rng.randrange(len(text) - 60)
        cut.append(" ".join(text[a : a + rng.randint(3, 45)].split("\n")[0].split('"')[0].split()).strip())
    named = 0
    for phrase in filter(None, cut):
        want = {i for i, t in hay.items() if phrase in t}
        found = phrases.candidates(index.positions, index.forms, phrase)
        if found is None:
            continue
        got = {r["doc_idx"] for r in found.collect()}
        assert want <= got, phrase
        named += len(got) < len(hay) // 2
    assert named > 25


def test_search(saved):
    index, hay = saved
    for phrase in ("Quick Start", "uick sta", "fine print", "точная фраза", "nowhere at all"):
        result = search(index, f'"{phrase}"')
        assert {r["doc_idx"] for r in result.ranked.collect()} == {i for i, t in hay.items() if phrase.lower() in t}
    plan = search(index, '"точная фраза"').ranked._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_idx" in plan.replace(" ", "") or "EqualTo(doc_idx" in plan.replace(" ", "")


def test_parts():
    assert phrases.parts("-Foo bar_b, x") == [("foo", True, False), ("bar_b", False, False), ("x", False, True)]
    assert phrases.parts("!!") == [] and phrases.parts("İ") is None
