"""The typo index against a comparison of all with all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumensift.operators import typos
from lumensift.operators.index import build, vocabulary
from lumensift.operators.search import nearest, search, search_batch
from lumensift.sources import corpora

TERMS = "term string, first_pos struct<doc_idx: bigint, field: int, pos: int>"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def made(seed: int, n: int, letters: str, longest: int) -> list[str]:
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)}
    return rng.sample(sorted(words), len(words))


def plain_nearest(words, terms, limit, most, looked_at):
    for w in set(words):
        near = [(distance(w, t), at, t) for at, t in enumerate(terms) if 1 <= distance(w, t) <= limit][:looked_at]
        yield from ((w, t, rank) for rank, (_, _, t) in enumerate(sorted(near)[:most], 1))


def frames(spark, words, terms):
    return spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t, (at, 0, 0)) for at, t in enumerate(terms)], TERMS)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_nearest(spark, limit):
    terms = made(1, 150, "abé\U0001f600", 5) + made(2, 120, "abcdef", 12)[:100]
    terms = list(dict.fromkeys(terms))
    words = made(3, 60, "abé\U0001f600", 6) + [t[:3] + "x" + t[4:] for t in terms[-60:]] + terms[:10] + ["zzzzzzzzzzzzzz"]
    asked, known = frames(spark, words, terms)
    got = typos.nearest(typos.entries(known, limit), typos.probes(asked, limit), limit, 3, 12)
    assert sorted(map(tuple, got.collect())) == sorted(plain_nearest(words, terms, limit, 3, 12))


def test_all_within(spark):
    """Without a bound on neighbours every near pair comes once, but for those of words as short as the limit."""
    terms, words = made(5, 200, "abc", 9), made(6, 80, "abc", 9)
    asked, known = frames(spark, words, terms)
    got = {(r["word"], r["term"], r["dist"]) for r in typos.within(typos.entries(known, 2), typos.probes(asked, 2), 2).collect()}
    assert got == {(w, t, d) for w in words for t in terms if 1 <= (d := distance(w, t)) <= 2}


def test_empty(spark):
    asked, known = frames(spark, ["ab"], ["abc"])
    assert typos.nearest(typos.entries(known.limit(0), 2), typos.probes(asked, 2), 2, 3, 12).count() == 0
    assert typos.nearest(typos.entries(known, 2), typos.probes(asked.limit(0), 2), 2, 3, 12).count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loop(spark, sf_dir, tmp_path):
    """Neither a query's typos nor those of a table of queries compare all words with all terms; a saved index reads the parts that were asked for alone."""
    index = build(corpora.parts(spark, sf_dir))
    index.save(str(tmp_path))
    saved = type(index).load(spark, str(tmp_path))
    lost = spark.createDataFrame([("wdget",), ("econom",)], "word string")
    for frame in (nearest(saved, lost, 3, 2), nearest(saved, lost, 3, 2, few=False), search_batch(saved, spark.createDataFrame([(1, "wdget"), (2, "econom")], "query_id bigint, query string"))):
        assert "NestedLoop" not in plan(frame) and "Cartesian" not in plan(frame.select("*"))
    few = nearest(saved, spark.createDataFrame([("wdget",)], "word string"), 3, 2, few=True)
    assert "In(part" in plan(few).replace(" ", "") and "NestedLoop" not in plan(few)
    assert search(saved, "wdget").resolved == search(index, "wdget").resolved
    assert sorted(map(tuple, nearest(saved, lost, 3, 2).collect())) == sorted(map(tuple, nearest(index, lost, 3, 2).collect()))


def test_index_saved_for_another_limit(spark, sf_dir, tmp_path):
    from lumensift.schema import EngineConfig

    index = build(corpora.parts(spark, sf_dir))
    index.save(str(tmp_path))
    loose = type(index).load(spark, str(tmp_path), EngineConfig(levenshtein_limit=3))
    assert loose.typos is None and search(loose, "wdgte").resolved.terms


def test_many_misspelt_words(spark, sf_dir):
    """Every term of a corpus with one letter changed finds its way back."""
    terms = build(corpora.documents(spark, sf_dir)).terms.select("term", "first_pos").where(F.char_length("term") > 7).persist()
    words = terms.select(F.concat(F.substring("term", 1, 3), F.lit("q"), F.expr("substring(term, 5)")).alias("word"), F.col("term").alias("was"))
    near = typos.within(typos.entries(terms, 2), typos.probes(words.select("word").distinct(), 2), 2)
    back = words.join(near.select(F.col("word").alias("w"), F.col("term").alias("t")), F.expr("word = w and was = t"), "left").where("word != was")
    assert back.where("t is null").count() == 0 and back.count() > 1000
    terms.unpersist()


def test_many_words_by_what_is_left_of_them(spark, monkeypatch):
    """Terms around the longest that are met by their rests, and shorter and longer ones, against all with all."""
    monkeypatch.setattr(typos, "LONGEST", 6)
    known, asked = made(11, 300, "abc", 9), made(12, 150, "abc", 10)
    terms = spark.createDataFrame([(t, (i, 0, 0)) for i, t in enumerate(known)], TERMS)
    words = spark.createDataFrame([(w,) for w in asked], "word string")
    near = {(r["word"], r["term"], r["first_pos"]["doc_idx"], r["dist"]) for r in typos.within_of_many(terms, words, 2, 10_000).collect()}
    assert near == {(w, t, i, distance(w, t)) for w in asked for i, t in enumerate(known) if 1 <= distance(w, t) <= 2}
    got = {tuple(r) for r in typos.nearest_of_many(terms, words, 2, 3, 12).collect()}
    assert got == {tuple(r) for r in typos.nearest(typos.entries(terms, 2), typos.probes(words, 2), 2, 3, 12).collect()}


def test_candidates_grow_with_the_vocabulary(spark):
    """Terms that share a part with a word, but little else, do not meet it."""
    rng = random.Random(13)
    known = sorted({"abc" + "".join(rng.choice("defghijklmnopq") for _ in range(6)) for _ in range(2000)})
    terms = spark.createDataFrame([(t, (i, 0, 0)) for i, t in enumerate(known)], TERMS)
    words = spark.createDataFrame([("abc" + "r" * 6,)], "word string")
    by_rest = typos.rests(terms.select(F.col("term").alias("word")), 2).join(typos.rests(words, 2).select("rest"), "rest")
    by_part = typos.entries(terms, 2).join(typos.probes(words, 2), list(typos.KEY))
    assert by_rest.count() == 0 and by_part.count() >= len(known)


def test_vocabulary_is_the_forms_of_an_index(spark):
    docs = corpora.from_objects(spark, [{"id": str(i), "title": t, "content": c, "keywords": k} for i, (t, c, k) in enumerate([("Docker", "running the runs", "x y"), ("", "docker ran", None), ("runs", "", "Docker")])])
    rows = lambda df: {(r["term"], r["word"], tuple(r["first_pos"])) for r in df.collect()}
    assert rows(vocabulary(docs)) == rows(build(docs).forms)
