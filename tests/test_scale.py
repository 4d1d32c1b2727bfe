"""Plans and patterns that keep work in proportion to the input."""

from __future__ import annotations

import re

import pytest
from pyspark.util import PythonEvalType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.functions import split
from lumensift.functions import text as X
from lumensift.operators import facets, phrases
from lumensift.operators.index import build, lengths, occurrences, word_counts
from lumensift.operators import search as S
from lumensift.operators.search import search, search_batch
from lumensift.plans.query import parsed_columns, parts_of
from lumensift.sources import corpora

#: All characters that NFKC cannot change, as one class: slow, but plain.
STABLE = "[\x00-\x7f\xc0-ıĴ-ľŁ-ňŊ-žЀ-ҁҊ-ԯ‐‒-―‘-„«»]"


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    return build(corpora.documents(spark, sf_dir))


def test_unstable_characters():
    """The ranges of nearly all characters come before the class, and change nothing."""
    assert X.UNSTABLE.startswith(r"(?![\x00-\x7F])")
    plain, fast = re.compile(STABLE), re.compile(X.UNSTABLE)
    odd = [c for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000 and bool(plain.fullmatch(c)) == bool(fast.search(c))]
    assert not odd


def test_words_are_found_once(spark, sf_dir):
    assert "size(" not in plan(occurrences(corpora.documents(spark, sf_dir)))


def test_counts_need_no_sort(index):
    assert "SortAggregate" not in index.counts._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in index.terms._jdf.queryExecution().executedPlan().toString()


def test_lengths_come_from_texts_alone(index):
    assert not re.search("Join|Aggregate|Generate", plan(index.doc_stats))


def test_numbers_of_an_index_need_no_postings(index):
    assert "tf_body" not in plan(facets.statistics(index)) and plan(facets.statistics(index)).count("Join") == 1


def test_few_terms_read_few_words(index):
    terms = ("thing", "erble")
    few = index.of_terms(terms)
    want = index.postings.where(index.postings["term"].isin(*terms))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, want.collect())) and few.count()
    assert index.of_terms(()).isEmpty()
    assert re.search("word#\\d+ (IN|=)|word#\\d+ INSET", plan(search(index, "thing -ering").ranked))


def test_batch_names_few_terms(spark, index, monkeypatch):
    queries = spark.createDataFrame([(1, "thing erble"), (2, "ering -thing"), (3, "the"), (4, "nicht @de")], "query_id long, query string")
    named = search_batch(index, queries, limit=5)
    assert re.search("word#\\d+ (IN|=)|word#\\d+ INSET", plan(named))
    monkeypatch.setattr(S, "NAMED", 0)
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, search_batch(index, queries, limit=5).collect()))


def test_places_are_rows(spark, sf_dir):
    rows = phrases.places(corpora.documents(spark, sf_dir))
    assert dict(rows.dtypes)["at"] == "int" and "Aggregate" not in plan(rows)


def test_words_inside_tasks(spark):
    """Words, counts and lengths that tasks make are those of the expressions."""
    texts = ["plain words, Words", "Docker-Compose the ﬁne ½ x_y", None, "", "İx ΑΣ i̇x", "é́ 1½ ﬁ"]
    rows = spark.createDataFrame([(i, t, "ﬁne the x", t) for i, t in enumerate(texts)], "doc_idx long, title string, keywords_text string, content string")
    said = occurrences(rows)
    places = F.min(F.shiftleft(F.col("field").cast("long"), 32) + F.col("pos")).alias("place")
    want = said.groupBy("word", "doc_idx").agg(*(F.count_if(F.col("field") == i).cast("int") for i in range(3)), places)
    assert sorted(map(tuple, word_counts(rows).collect())) == sorted(map(tuple, want.collect()))
    assert [split.words(t) for t in texts] == [r["w"] or [] for r in rows.select(X.raw_words(F.col("content")).alias("w")).collect()]
    sizes = rows.select("doc_idx", F.coalesce(F.size(X.words(F.coalesce("content", F.lit("")))), F.lit(0)))
    assert sorted(map(tuple, lengths(rows).collect())) == sorted(map(tuple, sizes.collect()))


def test_counts_are_not_aggregated(index):
    assert not re.search("Aggregate|Generate", plan(index.counts))
    assert not re.search("Aggregate|Generate", plan(phrases.places(index.docs)))


def test_saving_samples_nothing_and_keeps_words_once(spark, index, tmp_path, monkeypatch):
    dealt = []
    monkeypatch.setattr(type(index.docs), "repartitionByRange", lambda *_: dealt.append(1))
    index.save(tmp_path.as_uri())
    assert not dealt and not {"postings", "counts"} & {p.name for p in tmp_path.iterdir()}
    staged = spark.read.parquet(f"{tmp_path}/staged")
    assert staged.where("new").count() == index.postings.count() == staged.select("term", "doc_idx").distinct().count()


def test_queries_are_cut_once(spark):
    rows = spark.createDataFrame([('+ﬁne -b "a phrase" @En #t w " " +',), (None,), ("",)], "query string")
    once = rows.withColumn("parts", parts_of(F.col("query")))
    columns, plain = parsed_columns(F.col("query"), F.col("parts")), parsed_columns(F.col("query"))
    assert plan(once.select(*(c.alias(n) for n, c in columns.items()))).count("regexp_extract_all") == 1
    assert once.select(*(c.alias(n) for n, c in columns.items())).collect() == rows.select(*(c.alias(n) for n, c in plain.items())).collect()


def test_nfkc_has_one_text_at_a_time():
    """pandas would hold all texts of a batch as Python strings, before and after."""
    import pyarrow as pa

    assert X._nfkc.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert X._nfkc.func(pa.array(["ﬁne", None, "", "plain"])).to_pylist() == ["fine", None, "", "plain"]
