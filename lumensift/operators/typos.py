"""Terms within a few edits of words, without comparing all with all: a table of parts of the terms, met by equality.

A term of more than `limit` characters is cut into limit + 1 parts of nearly equal length. A word within `limit` edits of it has one of the parts unchanged, at
a place that is off by as many edits at most as lie on either side of the part; so a word asks for the few substrings that can be such a part, for each
length of a term within reach (19 for a limit of 2).

Terms of `limit` characters at most stand under each of their characters, one of which a longer word within reach shares. From a word that is as short as that itself all of them are within reach,
so for such words the first of these in the order of the index are enough, and only these meet them.

Where very many words are looked up (nearest_of_many), parts of two or three letters have too many terms each: the pairs to test would grow with the square of the
vocabulary. There, terms of up to LONGEST characters meet words by what is left of both without `limit` characters at most, which nearly only terms within reach share; parts are for longer terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of parts are numbers from 0; these stand for a character of a short term, and for a short term as a whole.
CHARACTER, WHOLE = -1, -2
KEY = ("size", "place", "part")
#: Characters of the longest terms that meet words by what is left of them. The number of rests grows with the square of the length.
LONGEST = 12
#: Words whose rests are made together.
TOGETHER = 2000


def _edge(size: Column, place: int, limit: int) -> Column:
    return F.floor(size * place / (limit + 1)).cast("int")


def _entry(size: Column, place: int, part: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), F.lit(place).alias("place"), part.alias("part"))


def _letters(word: Column) -> Column:
    """A bit for each character of a word (by its code mod 62). An edit changes two bits at most."""
    bits = F.transform(F.split(word, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 62))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _characters(word: Column) -> Column:
    return F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))


def entries(terms: DataFrame, limit: int) -> DataFrame:
    """(size, place, part, term, letters, first_pos) for terms(term, first_pos)."""
    term, size = F.col("term"), F.char_length("term")
    parts = F.array(*(_entry(size, i, term.substr(_edge(size, i, limit) + 1, _edge(size, i + 1, limit) - _edge(size, i, limit))) for i in range(limit + 1)))
    short = F.concat(F.transform(_characters(term), lambda c: _entry(size, CHARACTER, c)), F.array(_entry(F.lit(0), WHOLE, F.lit(""))))
    return terms.select(F.inline_outer(F.when(size > limit, parts).otherwise(short)), "term", _letters(term).alias("letters"), "first_pos")


def asked(word: Column, limit: int) -> Column:
    """The keys that a word asks for, as an array of structs."""
    own, parts = F.char_length(word), []
    for more in range(-limit, limit + 1):  # the word has so many characters more than the term
        size = own - more
        for i in range(limit + 1):
            start, length = _edge(size, i, limit), _edge(size, i + 1, limit) - _edge(size, i, limit)
            for off in range(max(-i, more - limit + i), min(i, more + limit - i) + 1):
                fits = (size > limit) & (start + off >= 0) & (start + off + length <= own)
                parts.append(F.when(fits, _entry(size, i, word.substr(start + off + 1, length))))
    long = F.filter(F.array(*parts), lambda x: x.isNotNull())
    reach = F.filter(F.array(*(F.lit(n) for n in range(1, limit + 1))), lambda n: n >= own - limit)
    by_character = F.flatten(F.transform(reach, lambda n: F.transform(_characters(word), lambda c: F.struct(n.cast("int").alias("size"), F.lit(CHARACTER).alias("place"), c.alias("part")))))
    short = F.when(own > limit, by_character).otherwise(F.array(_entry(F.lit(0), WHOLE, F.lit(""))))
    return F.array_distinct(F.concat(long, short))


def probes(words: DataFrame, limit: int) -> DataFrame:
    """(word, size, place, part): what each word(word) asks for."""
    return words.select("word", F.inline_outer(asked(F.col("word"), limit)))


def within(index: DataFrame, wanted: DataFrame, limit: int, most: int | None = None) -> DataFrame:
    """(word, term, first_pos, dist) of entries() and probes() that are 1 to `limit` edits apart. most: the caller looks at no more neighbours of a word, in the order of the index."""
    if most is not None:
        first = index.where(F.col("place") == WHOLE).orderBy("first_pos").limit(most + 1)  # the word itself may be one of them
        index = index.where(F.col("place") != WHOLE).unionByName(first)
    far = F.levenshtein(F.col("word"), F.col("term"), limit)
    asked_letters = wanted.withColumn("word_letters", _letters(F.col("word")))
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("word_letters"))) <= 2 * limit  # tested before edits are counted
    near = index.join(asked_letters, list(KEY)).where(alike).select("word", "term", "first_pos", far.alias("dist")).where(F.col("dist").between(1, limit))
    return near.groupBy("word", "term").agg(F.min("first_pos").alias("first_pos"), F.min("dist").alias("dist"))


def rests(words: DataFrame, limit: int) -> DataFrame:
    """(rest, word) of words(word): what is left of a word without 0 to `limit` of its characters, each once."""

    def of(word: str) -> set[str]:
        left = range(max(0, len(word) - limit), len(word) + 1)
        return {"".join(chosen) for n in left for chosen in combinations(word, n)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                found = [(rest, word) for word in batch.column(0).slice(start, TOGETHER).to_pylist() for rest in of(word)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["rest", "word"])

    return words.select("word").mapInArrow(run, "rest string, word string")


def within_of_many(terms: DataFrame, words: DataFrame, limit: int, most: int) -> DataFrame:
    """within(), for many words(word) and all terms(term, first_pos)."""
    size = F.char_length("term")
    by_rest = (size > limit) & (size <= LONGEST)
    reach = words.where(F.char_length("word") <= LONGEST + limit)
    met = rests(terms.where(by_rest).select(F.col("term").alias("word")), limit).withColumnRenamed("word", "term").join(rests(reach, limit), "rest")
    far = F.levenshtein(F.col("word"), F.col("term"), limit)
    near = met.where(far.between(1, limit)).select("word", "term").distinct().join(terms, "term").select("word", "term", "first_pos", far.alias("dist"))
    return near.unionAll(within(entries(terms.where(~by_rest), limit), probes(words, limit), limit, most))


def nearest(index: DataFrame, wanted: DataFrame, limit: int, most: int, looked_at: int) -> DataFrame:
    """(word, term, rank): of the first `looked_at` neighbours of a word in the order of the index the `most` nearest."""
    return _ranked(within(index, wanted, limit, looked_at), most, looked_at)


def nearest_of_many(terms: DataFrame, words: DataFrame, limit: int, most: int, looked_at: int) -> DataFrame:
    """nearest(), for many different words(word) and all terms(term, first_pos)."""
    return _ranked(within_of_many(terms, words, limit, looked_at), most, looked_at)


def _ranked(near: DataFrame, most: int, looked_at: int) -> DataFrame:
    seen = near.withColumn("seen", F.row_number().over(Window.partitionBy("word").orderBy("first_pos"))).where(F.col("seen") <= looked_at)
    rank = F.row_number().over(Window.partitionBy("word").orderBy("dist", "first_pos"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= most).select("word", "term", "rank")
