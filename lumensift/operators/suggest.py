"""Completions of a prefix, and corrections of a query without hits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumensift.functions.stopwords import STOP_WORDS
from lumensift.operators.index import SearchIndex
from lumensift.operators.search import SearchResult, _stems, nearest
from lumensift.schema import small

SAID = "Возможно, вы имели в виду: «{}»"


def last_word(query: str) -> str:
    return re.split(r"\s+", query.lower().strip())[-1]


def suggest(index: SearchIndex, query: str, limit: int = 8) -> DataFrame:
    """(ord, word): forms of the first `limit` terms, in the order of the index, that begin with the last word of the query but differ from it."""
    word = last_word(query)
    first = index.terms.where(F.col("term").startswith(word) & (F.col("term") != word) if word else F.lit(False)).orderBy("first_pos").limit(limit)
    forms = index.forms.select("term", "word", F.col("first_pos").alias("form_pos")).join(F.broadcast(first.select("term", "first_pos")), "term")
    best = forms.orderBy("first_pos", "form_pos").limit(limit)
    return best.select(F.row_number().over(Window.orderBy("first_pos", "form_pos")).alias("ord"), "word")


def merged_suggestions(index: SearchIndex, query: str, popular: DataFrame | None, limit: int = 8) -> DataFrame:
    """(ord, word): popular queries (ord, query) first, then completions that are not among them."""
    words = suggest(index, query, limit).select(F.lit(1).alias("source"), "ord", "word")
    if popular is not None:
        asked = popular.select(F.lit(0).alias("source"), "ord", F.col("query").alias("word"))
        words = asked.union(words.join(asked.select("word"), "word", "left_anti").select("source", "ord", "word"))
    best = words.orderBy("source", "ord").limit(limit)
    return best.select(F.row_number().over(Window.orderBy("source", "ord")).alias("ord"), "word")


def did_you_mean(result: SearchResult, lang: str = "auto") -> str | None:
    """A hint for a query with plain words, but neither hits nor a term that matched: its first word with a neighbour is replaced by the nearest one."""
    parsed = result.parsed
    if not parsed.words or result.resolved.matched or (result.limit and result.total):
        return None
    index, spark = result.index, result.index.terms.sparkSession
    asked = [raw for raw in (*parsed.required, *parsed.words) if raw.lower() not in STOP_WORDS]
    if not asked:
        return None
    stems = {w: r["stem"] for w, r in _stems(spark, index, [raw.lower() for raw in asked], lang).items()}
    rows = small(spark, [(s,) for s in dict.fromkeys(stems.values())], "word string")
    near = {r["word"]: r["term"] for r in nearest(index, rows, 1, index.config.levenshtein_limit, few=True).collect()}
    found = [(raw, near[stems[raw.lower()]]) for raw in asked if stems[raw.lower()] in near]
    if not found:
        return None
    wrong, right = found[0]
    if parsed.phrase:
        return SAID.format(parsed.phrase.replace(wrong.lower(), right, 1))
    shown = [(w, "") for w in parsed.words] + [(w, "+") for w in parsed.required]
    return SAID.format(" ".join(sign + (right if w == wrong else w) for w, sign in shown))
