"""SQL functions against the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumensift.functions import text as X
from lumensift.functions.sql import register_functions
from lumensift.operators.index import occurrences
from lumensift.queries import QUERIES
from lumensift.sources import corpora

RUSSIAN = ("контейнер", "контейнеры", "поиска", "поисковый", "новость", "Новость", "процесс", "данных", "ёлками", "бежавшись", "красивейшего", "читаемый", "смотрится", "радость", "й", "стр")
ODD = ("", "a", "İstanbul", "x_y-z", "don't", "ghbdtn", "цшвпуе", "a[b", "it;s", "naïve", "running", "agreed", "falling", "hoping", "sky", "probate", "controlled", "relational")


@pytest.fixture(scope="module")
def words(spark, sf_dir):
    register_functions(spark)
    known = occurrences(corpora.documents(spark, sf_dir)).select("word").distinct()
    back = known.select(X.layout_ru(F.col("word")).alias("word")).where("word is not null")  # Cyrillic words
    frame = known.unionAll(back).unionAll(spark.createDataFrame([(w,) for w in (*RUSSIAN, *ODD)], "word string")).distinct().persist()
    frame.createOrReplaceTempView("some_words")
    yield frame
    frame.unpersist()


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("lumen_stem", X.stem),
        ("lumen_stem_en", X.stem_en),
        ("lumen_stem_ru", X.stem_ru),
        ("lumen_layout_ru", X.layout_ru),
        ("lumen_layout_en", X.layout_en),
        ("lumen_is_stop", X.is_stop_word),
        ("lumen_lang", X.detect_lang),
        ("lumen_words", X.words_of),
    ],
)
def test_scalar_functions(spark, words, name, column):
    got = spark.sql(f"SELECT word, {name}(word) AS got FROM some_words").select("word", "got", column(F.col("word")).alias("want"))
    wrong = got.where(~F.col("got").eqNullSafe(F.col("want"))).limit(5).collect()
    assert not wrong and words.count() > 2000
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").createOrReplaceTempView("some_nations")
    plan = spark.sql(f"SELECT {name}(n_name) AS got FROM some_nations")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_table_function(spark, sf_dir):
    register_functions(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT id, pos, word FROM lumen_tokenize(TABLE(some_docs), 'doc_id', 'text') WHERE NOT stop")
    want = occurrences(corpora.documents(spark, sf_dir)).where("field = 2").select("doc_idx", "pos", "word")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    spark.createDataFrame([("k", None), ("l", ""), ("m", "ＡＢ the ½ x")], "k string, t string").createOrReplaceTempView("some_docs")
    assert [tuple(r) for r in spark.sql("SELECT * FROM lumen_tokenize(TABLE(some_docs), 'k', 't') ORDER BY pos").collect()][:2] == [("m", 0, "ab", False), ("m", 1, "the", True)]


def test_words_are_found_once(spark, sf_dir):
    """explode() would have Spark filter by the size of the words first, and find them twice."""
    plan = QUERIES["sql_stem_counts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and "explode(words" in plan


def test_table_function_gives_arrow_batches(spark, sf_dir):
    assert "ArrowEvalPythonUDTF" in QUERIES["sql_tokenize"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
