from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import text as X

STEMS = """
running run, containers contain, container contain, docker docker, search search, searching search, cache cach, caching cach, agreed agre,
relational relat, nation nation, rational ration, tree tre, bed bede, red rede, sing sing, gas ga, apps app, engine engin, pages page,
basics basic, thing thing, ering er, erble erbl, ément ément, контейнер контнер, контейнеры контнер, поиска поиск, поисковый поиск, новость нов,
процесс процес, данных данн, as as, hopping hop, falling fall, hissing hiss, filing file, happy happi, sky sky, conditional condition,
a1 a1, 123 123
"""


def test_stems(spark):
    pairs = [p.split() for p in STEMS.replace("\n", " ").split(",")]
    rows = spark.createDataFrame(pairs, "word string, wanted string").select("word", "wanted", X.stem(F.col("word")).alias("stem")).collect()
    assert [(r["word"], r["stem"]) for r in rows] == [(w, s) for w, s in pairs]


def test_stems_of_many_words(spark):
    """with_stem() and stem() agree, in each language."""
    words = [(w,) for p in STEMS.replace("\n", " ").split(",") for w in p.split()] + [("",), ("Ёлки",), ("mixédСлово",), ("Running",), ("is",)]
    rows = spark.createDataFrame(words, "word string")
    for lang in ("auto", "ru", "en"):
        assert all(r["one"] == r["many"] for r in X.with_stem(rows, "word", "many", lang).withColumn("one", X.stem(F.col("word"), lang)).collect())


def test_stem_of_the_other_language(spark):
    rows = spark.createDataFrame([("containers",), ("новость",)], "w string").select(X.stem(F.col("w"), "ru").alias("ru"), X.stem(F.col("w"), "en").alias("en")).collect()
    assert [tuple(r) for r in rows] == [("containers", "contain"), ("нов", "новость")]


def test_words(spark):
    texts = ["Docker-Compose the ﬁne x_y ½ ＡＢ --", None, "", "été"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.raw_words(F.col("t")).alias("raw"), X.words(F.col("t")).alias("kept")).collect()
    assert rows[0]["raw"] == ["docker-compose", "the", "fine", "x_y", "1", "2", "ab"]
    assert rows[0]["kept"] == ["docker-compose", "fine", "x_y", "1", "2", "ab"]
    assert rows[1]["raw"] is None and rows[2]["raw"] == [] and rows[3]["raw"] == ["été"]


def test_layouts(spark):
    words = {"ghbdtn": ("привет", None), "цшвпуе": (None, "widget"), "вщслук": (None, "docker"), "a1": (None, None), "x[": (None, None), "Ghbdtn": ("привет", None), "ёж": (None, "ё;")}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.layout_ru(F.col("w")).alias("ru"), X.layout_en(F.col("w")).alias("en")).collect()
    assert {r["w"]: (r["ru"], r["en"]) for r in rows} == words


def test_detect_lang(spark):
    rows = spark.createDataFrame([("Привет abc",), ("abcdef при",), ("123",)], "t string").select(X.detect_lang(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in rows] == ["ru", "en", "en"]


def test_normalised_rows(spark):
    texts = ["plain words", "Docker-Compose the ﬁne ½", None, "", "İx ΑΣ", "é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    both = X.normalised(rows, "t").select("n", X.words_of(F.col("t")).alias("w")).join(rows.select("n", X.raw_words(F.col("t")).alias("v")), "n").collect()
    assert len(both) == len(texts) and all(r["w"] == r["v"] for r in both)
    assert next(r["w"] for r in both if r["n"] == 4) == ["i̇x", "ας"]


def test_counting_words_does_not_shuffle_them(spark):
    from lumensift.operators.index import word_counts

    docs = spark.createDataFrame([(1, "a", "b", "c d")], "doc_idx long, title string, keywords_text string, content string")
    plan = word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_saved_look_ups_are_pruned(spark, tmp_path):
    from lumensift.operators.index import SearchIndex, build
    from lumensift.operators.search import search
    from lumensift.sources import corpora

    docs = spark.createDataFrame([(0, "a", "Docker intro", "Docker packs apps", None, None, "devops", "infra", None)], "doc_idx long, id string, title string, content string, keywords array<string>, tags array<string>, keywords_text string, category string, link string").select(*[f.name for f in corpora.DOC.fields])
    build(docs).save(tmp_path.as_uri())
    index = SearchIndex.load(spark, tmp_path.as_uri())
    result = search(index, "docker")
    plan = result.ranked._jdf.queryExecution().toString()
    assert plan.count("EqualTo(term,docker)") + plan.count("In(term") >= 2 and index.counted == (1, 3.0)
    assert [r["id"] for r in result.hits.collect()] == ["a"]
