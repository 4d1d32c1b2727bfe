from __future__ import annotations

import json

import pytest

from lumensift.api import SearchService, bool_param, lang_param, list_param, parse_limit
from lumensift.operators import catalog
from lumensift.operators.segments import GrowingIndex
from lumensift.schema import AppConfig, EngineConfig
from lumensift.sources import corpora
from lumensift.sources.state import Store
from lumensift.streaming import learner
from tests.test_search import DOCS


@pytest.fixture
def service(spark, tmp_path):
    made = SearchService.over(corpora.from_objects(spark, DOCS), AppConfig(state_path=str(tmp_path / "state"), learn="queries", bot_name="b"))
    yield made
    made.index.unpersist()


def test_parameters():
    assert [parse_limit(v, 7) for v in (None, "", "3.9", "-1", "x", "inf", 2)] == [7, 0, 3, 7, 7, 7, 2]
    assert list_param(" a, ,b") == ["a", "b"] and list_param(None) == []
    assert bool_param("", True) and bool_param("YES", False) and not bool_param("no", True)
    assert (lang_param("ru"), lang_param("fr")) == ("ru", "auto")


def test_configuration(tmp_path):
    (tmp_path / ".env").write_text("# x\nSEARCH_K1 = 2\nSEARCH_LEARN=queries\nSEARCH_B=oops\nnothing\n")
    config = AppConfig.from_env(str(tmp_path / ".env"), {"SEARCH_FUZZY": "off", "SEARCH_LEARN": "dataset"})
    assert (config.engine.k1, config.engine.b, config.engine.fuzzy, config.learn) == (2.0, 0.75, False, "dataset")
    assert AppConfig.from_env(None, {}).engine == EngineConfig()


def test_service(service):
    answer = service.search(query="docker", limit="1")
    assert (answer["total"], [h["id"] for h in answer["hits"]], answer["did_you_mean"]) == (2, ["a"], None)
    with pytest.raises(ValueError, match="query"):
        service.search(search="  ")
    service.search(search="docker search")
    assert service.suggest("doc") == ["docker", "docker search"]
    assert service.context()["learning"] == {"mode": "queries", "queries": 2}
    assert service.documents(limit="")["documents"] == [] and service.documents(tag="SEARCH")["total"] == 1
    assert service.backup() and service.restore()["queries"] == 2
    assert service.flush() and service.health()["docs"] == 2
    assert [r["name"] for r in service.bots.list().collect()] == ["b"] and service.bots.remove("b") and not service.bots.remove("b")
    reply = service.ask(lambda prompt: prompt.splitlines()[-1], question="docker")
    assert reply.answer == "Вопрос: docker" and reply.sources[0] == {"id": "1", "title": "Docker intro", "link": ""}
    assert service.import_dataset({"documents": [*DOCS[:1], {"id": 1}]}) == 1 and service.dataset()["total"] == 1


def test_datasets(spark, tmp_path):
    rows = [{**DOCS[0], "keywords": "x, y z"}, {"id": "bad"}, {**DOCS[1], "tags": None}]
    for name, value in (("array", rows), ("envelope", {"documents": rows})):
        (tmp_path / name).write_text(json.dumps(value))
        docs = corpora.read_dataset(spark, str(tmp_path / name)).orderBy("doc_idx").collect()
        assert [(d["id"], d["keywords"], d["keywords_text"]) for d in docs] == [("a", ["x", "y", "z"], "x, y z"), ("b", None, None)]
    with pytest.raises(ValueError, match="valid"):
        corpora.from_objects(spark, [{"id": "x"}])
    with pytest.raises(ValueError, match="array"):
        corpora.from_objects(spark, "x")
    docs = corpora.from_objects(spark, rows)
    corpora.write_dataset(docs, str(tmp_path / "out"))
    corpora.write_dataset(docs, str(tmp_path / "out"))
    assert (tmp_path / "out.previous").is_dir()
    assert {r["id"] for r in corpora.read_lines(spark, str(tmp_path / "out")).collect()} == {"a", "b"}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load().count() == 0 and store.restore() is None
    counts = learner.remember(spark.createDataFrame([(" A ",), ("a",), ("b",), ("  ",), (None,)], "query string"))
    assert store.save(counts) and {tuple(r) for r in store.load().collect()} == {("a", 2), ("b", 1)}
    first, second = store.backup(store.load()), store.backup(counts.where("n > 1"))
    assert [f"{store.backups}/{n}" for n in store.snapshots()] == [second, first]
    assert store.restore()[0] == second.rpartition("/")[2] and store.load().count() == 1
    off = Store(spark, str(tmp_path / "off"), enabled=False)
    assert not off.save(counts) and off.backup(counts) is None


def test_learning(spark):
    state = spark.createDataFrame([("ab", 2.7), ("aa", 2.0), ("b", 0.2)], "query string, n double")
    kept = learner.replaced(state)
    assert {r["query"]: r["n"] for r in kept.collect()} == {"ab": 2, "aa": 2, "b": 1}
    assert [r["query"] for r in learner.top(kept, " A", 5).orderBy("ord").collect()] == ["aa", "ab"]
    assert learner.added(kept, kept).where("query = 'b'").first()["n"] == 2


def test_catalogue(spark):
    rows = catalog.provider_rows()
    assert (len(rows), len({r[2] for r in rows})) == (68, 4)
    assert catalog.providers(spark, "локальные", "LLAMA").count() > 0
    with pytest.raises(ValueError, match="name"):
        catalog.BotRegistry(spark).register(" ", "x")


def test_commands_are_trimmed_and_distinct(spark):
    rows = spark.createDataFrame([(0, "a", "x", ["1 ", " 1", "", " /b ", "/turn1"]), (1, " a ", "y", [" /c", "/c ", "0"])], "ord bigint, name string, platform string, commands array<string>")
    assert [tuple(r) for r in catalog.clean_bots(rows).collect()] == [(0, "a", "y", ["/c", "0"])]
    assert catalog.clean_bots(rows.where("ord = 0")).first()["commands"] == ["1", "/b", "/turn1"]


def test_service_over_a_growing_index(spark, tmp_path):
    growing = GrowingIndex(spark, str(tmp_path / "g"))
    growing.add(corpora.from_objects(spark, DOCS))
    service = SearchService.on(growing, AppConfig(state_path=str(tmp_path / "state")))
    assert service.add_documents([{"id": "new", "title": "Zebra docker", "content": "stripes"}, {**DOCS[1], "content": "only stripes now"}]) == 3
    assert {h["id"] for h in service.search(query="stripes")["hits"]} == {"new", DOCS[1]["id"]}
    assert service.delete_documents(["new"]) == 2 and service.search(query="zebra", fuzzy=False)["total"] == 2  # a word that nothing resolves is left out
    with pytest.raises(ValueError, match="grow"):
        SearchService(spark, service.index, service.config).delete_documents(["x"])
