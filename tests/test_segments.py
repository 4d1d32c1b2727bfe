"""A growing index against one that is built over the final set."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumensift.operators.index import build
from lumensift.operators.search import search
from lumensift.operators.segments import GrowingIndex
from lumensift.schema import EngineConfig
from lumensift.sources import corpora
from lumensift.sources.versions import Conflict, VersionLog

QUERIES = ("docker search", "dcoker -serch")


def objects(*names):
    texts = {
        "a": ("Docker intro", "Docker containers run everywhere. Quick start."),
        "b": ("Search engine", "A search engine ranks documents, searching postings."),
        "c": ("Docker search", "Searching dockers with an engine"),
        "d": ("Notes", "containers and searches; dock"),
        "e": ("Интро", "поиск контейнеров docker"),
        "f": ("Docker again", "running ran runs docker dockers"),
    }
    return [{"id": n, "title": texts[n][0], "content": texts[n][1], "tags": ["x", n], "keywords": "k " + n} for n in names]


def corpus(spark, names, first=0):
    return corpora.from_objects(spark, objects(*names)).withColumn("doc_idx", F.col("doc_idx") + first)


def rows(df):
    return sorted(map(repr, df.collect()))


def same_index(view, want):
    view.persist()
    for name in ("postings", "terms", "forms", "doc_stats"):
        columns = getattr(want, name).columns
        assert rows(getattr(view, name).select(*columns)) == rows(getattr(want, name)), name
    assert rows(view.typos.select(*want.typos.columns)) == rows(want.typos)
    assert view.corpus == want.corpus
    for query in QUERIES:
        got, expected = search(view, query), search(want, query)
        assert got.resolved == expected.resolved, query
        assert [tuple(r) for r in got.hits.select("rank", "id", "score").collect()] == [tuple(r) for r in expected.hits.select("rank", "id", "score").collect()], query
    view.unpersist()


def test_growing(spark, tmp_path):
    growing = GrowingIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="no documents"):
        growing.view()
    growing.add(corpus(spark, "abc"))
    growing.add(corpus(spark, "de", 10))
    with pytest.raises(ValueError, match="doc_idx"):
        growing.add(corpus(spark, "f", 11))
    growing.add(corpus(spark, "f", 20))
    before = growing.view()
    growing.delete(spark.createDataFrame([("a",), ("e",), ("nobody",)], "id string"))
    left = corpus(spark, "abc").unionByName(corpus(spark, "de", 10)).unionByName(corpus(spark, "f", 20)).where("id not in ('a', 'e')")
    want = build(left).persist()
    same_index(growing.view(), want)
    assert before.docs.count() == 6  # a reader of the version before still has it
    growing.merge(2)  # two have tombstones, so they go with the smallest
    growing.prune()
    (segment,) = growing._segments()[1]
    assert segment["gone"] == [] and segment["n"] == 4
    same_index(growing.view(), want)


def test_replace_and_empty(spark, tmp_path):
    growing = GrowingIndex(spark, str(tmp_path / "i"))
    growing.add(corpus(spark, "ab"))
    fresh = corpus(spark, "b", 5).withColumn("content", F.lit("replaced words"))
    growing.replace(fresh)
    same_index(growing.view(), build(corpus(spark, "a").unionByName(fresh)).persist())
    growing.delete(spark.createDataFrame([("a",), ("b",)], "id string"))
    assert growing._segments()[1] == []
    with pytest.raises(ValueError, match="another"):
        GrowingIndex(spark, str(tmp_path / "i"), EngineConfig(lang="en")).add(corpus(spark, "c"))


def test_a_stopped_writer_changes_nothing(spark, tmp_path, monkeypatch):
    growing = GrowingIndex(spark, str(tmp_path / "i"))
    growing.add(corpus(spark, "ab"))
    want = build(corpus(spark, "ab"))

    def stop(*_):
        raise RuntimeError("stopped")

    for step in ("_commit", "_described"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(GrowingIndex, step, stop)
            growing.delete(spark.createDataFrame([("a",)], "id string"))
        assert rows(growing.view().terms.select(*want.terms.columns)) == rows(want.terms)
    (tmp_path / "i" / "log" / "0000000007.json").write_text('{"segments": [')  # a commit that was cut off
    assert growing.view().corpus == want.corpus
    growing.add(corpus(spark, "c", 9))
    assert growing.log.latest()[0] == 8 and growing.view().docs.count() == 3


def test_one_of_two_writers_commits(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "l"))
    assert log.latest() == (0, {})
    assert log.commit({"a": 1}, 0) == 1
    with pytest.raises(Conflict):
        log.commit({"a": 2}, 0)
    assert log.commit({"a": 3}, 1) == 2 and log.latest() == (2, {"a": 3})
