"""Documents that may hold a phrase, from the places of their words.

A phrase is found as a substring of title and content, so its first word may be the end of a longer one, and its last the beginning. The places of a document's indexed words, title before
content, say where the words of a phrase follow each other; the substring test then reads the few documents that are left. Words that the ends of a phrase may belong to come from the
dictionary. Stop words have no places, and count as a gap.

Texts that normalisation may change have other words than letters, so such documents are always among those that are tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.functions import split
from lumensift.functions import text as X
from lumensift.functions.stopwords import STOP_WORDS
from lumensift.schema import small

#: Words of the dictionary that an end of a phrase may belong to; with more, that end says too little.
ENDS = 1000
#: Documents that are named to the scan; more are joined.
NAMED = 10_000
#: Stands for a word, with the documents that are always tested.
ALWAYS = ""


def places(docs: DataFrame) -> DataFrame:
    """(word, doc_idx, at): each place, from 0 over title and content, of an indexed word of a document. ALWAYS has documents without places."""
    words = docs.select("doc_idx", "title", "content").mapInArrow(split.placed, "word string, doc_idx bigint, at int")
    odd = docs.where(F.concat_ws(" ", "title", "content").rlike(X.UNSTABLE) | F.contains(F.concat_ws(" ", "title", "content"), F.lit("İ")))
    return words.unionAll(odd.select(F.lit(ALWAYS), "doc_idx", F.lit(None).cast("int")))


def parts(phrase: str) -> list[tuple[str, bool, bool]] | None:
    """The words of a phrase in lower case, and whether each may go on before and behind. None if lower case alone does not make them."""
    import regex

    low = phrase.lower()
    if "İ" in phrase:
        return None
    joins = lambda c: c in "-_"
    return [(m[0], m.start() == 0 or joins(low[m.start() - 1]), m.end() == len(low) or joins(low[m.end()])) for m in regex.finditer(X.WORD, low)]


def _belongs(word, part: str, before: bool, behind: bool):
    """Whether a dictionary word may hold a part of a phrase: a column or a string."""
    if before and behind:
        return F.contains(word, F.lit(part)) if not isinstance(word, str) else part in word
    if before:
        return word.endswith(part)
    return word.startswith(part) if behind else word == part


def candidates(positions: DataFrame, forms: DataFrame, phrase: str) -> DataFrame | None:
    """(doc_idx) of the documents that may hold a phrase; None if its words do not say."""
    found = parts(phrase)
    wanted: list[tuple[str, int]] = []
    held = 0
    for place, (part, before, behind) in enumerate(found or []):
        if any(_belongs(stop, part, before, behind) for stop in STOP_WORDS):
            continue
        if before or behind:
            own = [r["word"] for r in forms.where(_belongs(F.col("word"), part, before, behind)).select("word").distinct().limit(ENDS + 1).collect()]
            if len(own) > ENDS:
                continue
        else:
            own = [part]
        wanted += [(word, place) for word in own]
        held += 1
    if not held:
        return None
    named = small(positions.sparkSession, wanted, "word string, place int") if wanted else small(positions.sparkSession, [(ALWAYS, -1)], "word string, place int").limit(0)
    rows = positions.where(F.col("word").isin(*{w for w, _ in wanted})) if wanted else positions.limit(0)
    met = rows.join(F.broadcast(named), "word").select("doc_idx", "place", F.col("at").alias("pos"))
    in_row = met.groupBy("doc_idx", (F.col("pos") - F.col("place")).alias("start")).agg(F.count_distinct("place").alias("n")).where(F.col("n") == held)
    return in_row.select("doc_idx").union(positions.where(F.col("word") == ALWAYS).select("doc_idx")).distinct()


def among(docs: DataFrame, found: DataFrame | None) -> DataFrame:
    """docs with these doc_idx: few are named to the scan, which skips row groups without them; more are joined."""
    if found is None:
        return docs
    few = [r["doc_idx"] for r in found.limit(NAMED + 1).collect()]
    return docs.where(F.col("doc_idx").isin(*few)) if len(few) <= NAMED else docs.join(found, "doc_idx", "left_semi")
