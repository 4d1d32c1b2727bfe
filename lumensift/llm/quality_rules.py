"""Quality rules as one Spark projection.

A table of thresholds over length, symbol, stop-word and line ratios is compiled into Spark columns; no user function
runs. Heavy intermediate arrays (words, lines, window hashes) are columns of an inner projection, so each is built once.

Null text: no words, so every count is 0 and the base rule rejects it; lines need a word to count as repeated. Null
doc_id and repeated rows: each row is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import quoted

#: Words are runs of anything but these white-space characters; symbols.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20

#: Frequent function words of the four languages.
STOP_WORDS = tuple(
    "the of and to in is that for on with as was by at it be are this from an a or had not but "
    "de la le et les des un une en du est que qui dans pour par sur pas plus au ce il elle "
    "der die das und ein eine zu mit den von auf für ist nicht sich dem des im auch als es "
    "el los las y del una por con no su al lo se para como más pero".split()
)


@dataclass(frozen=True)
class Rule:
    """A document of from_words words at least fails if count (divided by the count `per`) is under `least` or over `most`."""

    name: str
    count: str
    per: str | None = None
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Over the columns of measured().
RULES = (
    Rule("too long", "n_words", most=1_000_000),
    Rule("word length", "word_chars", per="n_words", most=25),
    Rule("symbols", "n_symbols", per="n_words", most=0.3),
    Rule("stop words", "n_stop_words", per="n_words", least=0.06, from_words=30),
    Rule("repeated lines", "n_dup_lines", per="n_lines", most=0.4),
    Rule("emphasis", "n_exclaimed", per="n_words", most=0.3),
)
#: The counts, in the order in which judged() has them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_exclaimed")


def _covered(flagged: Column, n: int) -> Column:
    """Positions that windows of n cover, given the ascending starts."""
    steps = F.transform(flagged, lambda p, j: F.least(F.lit(n), F.coalesce(F.try_element_at(flagged, (j + 2).cast("int")) - p, F.lit(n))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame, carried: Column) -> DataFrame:
    """`carried` and the counts of each row of docs(text, ...)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        carried.alias("carried"),
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!!")).cast("long").alias("n_exclaimed"),
    )
    n = F.size("words")
    at = lambda i, k: F.get("words", (i + k).cast("int"))
    hashed = split.select(
        "*",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    found = hashed.select("*", (F.size(F.array_distinct("windows")) < F.size("windows")).alias("repeats"))
    ordered = found.select("*", F.when(F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda x, k: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    flagged = ordered.select("*", F.array_sort(F.filter(F.transform("sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda p: p.isNotNull())).alias("flagged"))
    counts = (
        n.alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.col("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.col("repeats"), _covered(F.col("flagged"), WINDOW)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).alias("n_stop_words"),
        F.size("lines").alias("n_lines"),
        F.col("n_exclaimed"),
    )
    # A generator of one row: Spark would push a filter on a verdict below plain projections, and compute their arrays anew for every element.
    return flagged.select("carried", F.inline(F.array(F.struct(*(c.cast("long").alias(name) for c, name in zip(counts, COUNTS, strict=True))))))


def failures(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of measured() fails. A ratio to 0 fails nothing."""
    tests = []
    for rule in rules:
        value = F.try_divide(rule.count, rule.per) if rule.per else F.col(rule.count)
        bad = [value < rule.least] if rule.least is not None else []
        bad += [value > rule.most] if rule.most is not None else []
        tests.append(F.when(reduce(or_, bad) & (F.col("n_words") >= rule.from_words), F.lit(rule.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def _judged(docs: DataFrame, carried: Column, rules: tuple[Rule, ...]) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = measured(docs, carried).select("*", base.alias("base_failed"), failures(rules).alias("failed_rules"))
    return rows.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of failed rules for each row of docs(doc_id, text, ...)."""
    return _judged(docs, docs["doc_id"].cast("long"), rules).select(F.col("carried").alias("doc_id"), *COUNTS[:5], "base_failed", "kept", *COUNTS[5:], "failed_rules")


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns. Each row carries its verdict; nothing is joined or shuffled."""
    return _judged(docs, F.struct(*(docs[quoted(c)] for c in docs.columns)), rules).where("kept").select("carried.*")
