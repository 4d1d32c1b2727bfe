from __future__ import annotations

import math

import pytest

from lumensift.operators import facets
from lumensift.operators.highlight import fragments, with_fragments
from lumensift.operators.index import SearchIndex, build
from lumensift.operators.search import search, search_batch
from lumensift.operators.suggest import did_you_mean, suggest
from lumensift.sources.corpora import from_objects

DOCS = [
    {"id": "a", "title": "Docker intro", "content": "Docker packs apps", "keywords": ["docker"], "tags": ["devops"], "category": "infra"},
    {"id": "b", "title": "Search basics", "content": "search engine ranks docker pages", "tags": ["Search", "devops"], "category": "Core"},
]


@pytest.fixture(scope="module")
def index(spark):
    made = build(from_objects(spark, DOCS)).persist()
    yield made
    made.unpersist()


def found(result):
    return [(r["id"], r["score"]) for r in result.hits.collect()]


def test_dictionary(index):
    assert [r["term"] for r in index.dictionary().collect()] == "docker intro pack app search basic engin rank page".split()
    assert index.corpus == (2, 4.0)


def test_scores(index):
    idf = math.log(1.2)
    assert found(search(index, "docker")) == [("a", round(8.5 * idf * 2.2 / 1.975, 3)), ("b", round(idf * 2.2 / 2.425, 3))] == [("a", 1.726), ("b", 0.165)]


@pytest.mark.parametrize(
    ("query", "ids"),
    [("docker -search", "a"), ("docker #devops @core", "b"), ("docker search", "b"), ('"ranks docker"', "b"), ("the", "ab"), ("dokcer", "ab"), ("вщслук", "ab"), ("", ""), ("docker @none", ""), ("zzzzzzzz", "ab"), ("+the docker", "ab")],
)
def test_queries(index, query, ids):
    result = search(index, query)
    assert "".join(i for i, _ in found(result)) == ids
    assert result.total == len(ids)


def test_options(index):
    assert [i for i, _ in found(search(index, "docker @core", category="infra"))] == ["a"]
    assert [i for i, _ in found(search(index, "docker #search", tags=[]))] == ["a", "b"]
    assert found(search(index, "dokcer", fuzzy=False)) == [("a", 0.0), ("b", 0.0)]
    limited = search(index, "docker", limit=1)
    assert (len(found(limited)), limited.total) == (1, 2)


def test_a_word_more_finds_no_more(index):
    assert search(index, "docker page").total <= search(index, "docker").total


def test_fragments(index):
    rows = with_fragments(search(index, "docker")).orderBy("rank").collect()
    assert rows[1]["fragments"] == ["search engine ranks <mark>docker</mark> pages"]
    assert rows[0]["fragments"] == ["<mark>Docker</mark> packs apps"]


def test_fragments_of_texts():
    assert fragments("", ["a"]) == fragments(None, []) == []
    assert fragments("x" * 50, []) == ["x" * 42 + "…"]
    assert fragments("x" * 50, ["y"]) == ["x" * 42]
    assert fragments("aaa", ["aa"]) == ["<mark>aa</mark>a"]
    long = "x" * 60 + "cat" + "y" * 60
    assert fragments(long, ["CAT"]) == ["…" + "x" * 21 + "<mark>cat</mark>" + "y" * 21 + "…"]
    assert len(fragments("cat " * 40, ["cat"])) == 2


def test_suggest(index):
    words = lambda q: [r["word"] for r in suggest(index, q).orderBy("ord").collect()]
    assert words("my doc") == ["docker"]
    assert words("docker") == words("") == []


def test_did_you_mean(index):
    assert did_you_mean(search(index, "dokcer", fuzzy=False, limit=0)) == "Возможно, вы имели в виду: «docker»"
    assert did_you_mean(search(index, 'dokcer "a dokcer b"', fuzzy=False)) == "Возможно, вы имели в виду: «a docker b»"
    assert did_you_mean(search(index, "docker @none")) is None


def test_facets(index):
    assert {tuple(r) for r in facets.both(index.docs).collect()} == {("category", "infra", 1), ("category", "core", 1), ("tag", "devops", 2), ("tag", "search", 1)}
    assert facets.statistics(index).first().asDict() == {"docs": 2, "terms": 9, "avg_field_length": 4.0}
    assert [r["id"] for r in facets.page(index.docs, category="CORE").collect()] == ["b"]
    assert [r["id"] for r in facets.page(index.docs, limit=1, offset=1).collect()] == ["b"]


def test_batch_is_search(spark, index):
    queries = ["docker", "docker search", "dokcer", "the", "docker -search", "вщслук @infra", '"ranks docker"', "docker #search", "", "zzzzzzzz"]
    rows = search_batch(index, spark.createDataFrame([*enumerate(queries)], "query_id int, query string")).collect()
    for i, q in enumerate(queries):
        assert [(r["id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i] == found(search(index, q)), q


def test_saved_index(spark, index, tmp_path):
    index.save(str(tmp_path))
    assert found(search(SearchIndex.load(spark, str(tmp_path)), "docker")) == found(search(index, "docker"))


def test_empty_corpus(spark, index):
    empty = build(index.docs.limit(0))
    assert (search(empty, "docker").total, empty.corpus) == (0, (0, 0.0))
    assert facets.statistics(empty).first()["avg_field_length"] == 0
