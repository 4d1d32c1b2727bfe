from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumensift.plans.query import ParsedQuery, parse, parsed_columns

CASES = {
    "+a -b c": ParsedQuery(["a"], ["b"], ["c"]),
    '"x y" "z"': ParsedQuery(phrase="z"),
    "@One @Two t": ParsedQuery(words=["t"], category="two"),
    "#A #b": ParsedQuery(tags=["a", "b"]),
    '+ - @ # ""': ParsedQuery(words=["+", "-", "@", "#", '""']),
    '"  "': ParsedQuery(phrase=""),
    'docker, "a"b "c': ParsedQuery(words=["docker,", "b", '"c'], phrase="a"),
}


@pytest.mark.parametrize("text", CASES)
def test_parse(text):
    assert parse(text) == CASES[text]


def test_columns_agree(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "q string")
    for r in rows.select("q", *(c.alias(n) for n, c in parsed_columns(F.col("q")).items())).collect():
        want = CASES[r["q"]]
        assert {n: r[n] for n in ("required", "excluded", "words", "phrase", "category", "tags")} == vars(want)
