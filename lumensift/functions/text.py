"""Words and stems as column expressions.

Everything runs in the JVM but for NFKC normalisation, which Spark lacks: texts that it can change (few) go through an Arrow
function, all others pass it as nulls.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.functions.stopwords import STOP_WORDS

#: A word: letters and digits, with single hyphens or underscores inside.
WORD = r"[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*"
#: A character that NFKC may change, or that may combine with the one before: anything outside plain Latin and Cyrillic. The ranges of nearly all characters are tested
#: one by one before the class: a class of many ranges asks all of them for each character, which took ten times as long.
UNSTABLE = "(?![\\x00-\\x7F])(?![\\xC0-\\u0131])(?![\\u0400-\\u0481])[^\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u048A-\\u052F\\u2010\\u2012-\\u2015\\u2018-\\u201E«»]"
CYRILLIC = "[а-яёА-ЯЁ]"
LATIN = "[a-zA-Z]"


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    """One text at a time is a Python string, as a batch may have ten thousand whole documents."""
    return pa.array((t and unicodedata.normalize("NFKC", t) for t in (v.as_py() for v in text)), pa.string())


def nfkc(text: Column) -> Column:
    unstable = text.rlike(UNSTABLE)
    return F.when(unstable, _nfkc(F.when(unstable, text))).otherwise(text)


def normalised(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with nfkc() of some columns. Rows that it cannot change take a branch of their own, which no Python worker sees."""
    odd = F.coalesce(F.concat_ws(" ", *columns).rlike(UNSTABLE), F.lit(False))
    return rows.where(~odd).unionAll(rows.where(odd).withColumns({c: nfkc(F.col(c)) for c in columns}))


def words_of(text: Column) -> Column:
    """All words of a normalised text, in lower case, stop words included. In lower case, İ alone is more than a letter."""
    found = lambda t: F.regexp_extract_all(t, F.lit(WORD), 0)
    return F.when(F.contains(text, F.lit("İ")), F.transform(found(text), F.lower)).otherwise(found(F.lower(text)))


def raw_words(text: Column) -> Column:
    """All words of a text, in lower case, stop words included."""
    return words_of(nfkc(text))


def is_stop_word(word: Column) -> Column:
    return word.isin(*sorted(STOP_WORDS))


def words(text: Column) -> Column:
    """The words of a text that are indexed, in lower case."""
    return F.filter(raw_words(text), lambda w: ~is_stop_word(w))


def has_cyrillic(text: Column) -> Column:
    return text.rlike(CYRILLIC)


def detect_lang(text: Column) -> Column:
    """ru if a text has Cyrillic letters, and as many as Latin ones at least; else en."""
    cyrillic, latin = F.regexp_count(text, F.lit(CYRILLIC)), F.regexp_count(text, F.lit(LATIN))
    return F.when((cyrillic > 0) & (cyrillic >= latin), "ru").otherwise("en")


# --- English -----------------------------------------------------------------------------------------------------------

# Suffixes and what replaces them, in the order in which they are tried, and the vowels.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""), ("ent", ""),
    ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
)
VOWELS = "aeiouy"


_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
#: Stems with more than 0 and more than 1 groups of vowels. Lazy, so that of the suffixes that fit the longest one goes: where one
#: suffix of a list ends another, the longer comes first, so this is the first that fits.
OVER_0, OVER_1 = f".*?{_V}.*?", f".*?{_V}{_C}+{_V}.*?"
#: Follows a word that had ed or ing, whether or not that went.
MARK = "\x01"


def _ends(*suffixes: str) -> Callable[[Column], Column]:
    """Whether a word ends as one of the suffixes does, in two letters: few words come to the patterns, which are slow."""
    return lambda w: F.right(w, F.lit(2)).isin(*sorted({s[-2:] for s in suffixes}))


def _replaced(pairs: Sequence[tuple[str, str]], stem: str) -> Callable[[Column], Column]:
    pattern = f"^({stem})({'|'.join(suffix for suffix, _ in pairs)})$"
    ends = _ends(*(suffix for suffix, _ in pairs))
    if not any(to for _, to in pairs):
        return lambda w: F.when(ends(w), F.regexp_replace(w, pattern, "$1")).otherwise(w)

    def replace(w: Column) -> Column:
        by_suffix = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
        return F.when(ends(w) & w.rlike(pattern), F.concat(F.regexp_extract(w, pattern, 1), F.element_at(by_suffix, F.regexp_extract(w, pattern, 2)))).otherwise(w)

    return replace


def _plural(w: Column) -> Column:
    return F.when(w.endswith("s"), F.regexp_replace(w, "^(.*(?:ss|i))es$|^(.*[^s])s$", "$1$2")).otherwise(w)


def _past(w: Column) -> Column:
    return F.when(w.endswith("eed"), F.regexp_replace(w, f"^(.*{_V}.*)eed$", "$1ee")).when(w.endswith("ed") | w.endswith("ing"), F.regexp_replace(w, f"^(.*{_V}.*)(?:ed|ing)$|^(.*(?:ed|ing))$", f"$1$2{MARK}")).otherwise(w)


def _mended(w: Column) -> Column:
    """After ed and ing: at, bl and iz get an e; a double consonant but l, s and z goes; a short word of one group gets an e."""
    with_e = w.rlike(f"(?:at|bl|iz){MARK}$") | w.rlike(f"^{_C}+{_V}[^{VOWELS}wx]{MARK}$")
    return F.when(~w.endswith(MARK), w).when(with_e, F.translate(w, MARK, "e")).otherwise(F.regexp_replace(w, f"([^{VOWELS}lsz])\\1{MARK}$|{MARK}$", "$1"))


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y"), F.regexp_replace(w, f"^(.*{_V}.*)y$", "$1i")).otherwise(w)


def _final_e(w: Column) -> Column:
    one_group, short = w.rlike(f"^{_C}*{_V}+{_C}*e$"), w.rlike(f"{_C}{_V}[^{VOWELS}wx]e$")
    return F.when(~w.endswith("e"), w).when(one_group & ~short, F.regexp_replace(w, "e$", "")).otherwise(F.regexp_replace(w, f"^({OVER_1})e$", "$1"))


def _final_double(w: Column) -> Column:
    return F.when(F.right(w, F.lit(1)).isin("l", "s", "z"), F.regexp_replace(w, f"^({OVER_1}([lsz]))\\2$", "$1")).otherwise(w)


ENGLISH_STEPS = (_plural, _past, _mended, _final_y, _replaced(STEP_2, OVER_0), _replaced(STEP_3, OVER_0), _replaced(STEP_4, OVER_1), _final_e, _final_double)

# --- Russian -----------------------------------------------------------------------------------------------------------

# Patterns of endings, and the vowels. In those of verbs the first alternatives match anywhere, which results depend on.
GERUND = "(?:ив|ивши|ившись|ыв|ывши|ывшись|(?<=[ая])(?:в|вши|вшись))$"
ADJECTIVE = "(?:ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)$"
PARTICIPLE = "(?:ивш|ывш|ующ|(?<=[ая])(?:ем|нн|вш|ющ|щ))$"
REFLEXIVE = "(?:с|ся)$"
VERB = (
    "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ять|ует|уют|ют|уйте|ите|ишь|ила|и"
    "ли|ыла|ыли|ый|ым|ому|ыми|ей|ое|ился|илась|ились|енось|итесь"
    "|(?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)$"
)
NOUN = "(?:а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$"
RUSSIAN_VOWELS = "аеиоуыэюя"


def _without(pattern: str) -> Callable[[Column], Column]:
    """Removes the first match."""
    return lambda rest: F.regexp_replace(rest, f"^(.*?)(?:{pattern})", "$1")


_gerund, _reflexive, _adjective, _participle, _verb, _noun = map(_without, (GERUND, REFLEXIVE, ADJECTIVE, PARTICIPLE, VERB, NOUN))


def stem_ru(word: Column) -> Column:
    """The Russian stem of a word."""
    vowel, other = f"[{RUSSIAN_VOWELS}]", f"[^{RUSSIAN_VOWELS}]"
    plain = F.translate(F.lower(word), "ё", "е")
    head = F.regexp_extract(plain, f"^(.*?{vowel})(.*)$", 1)
    rest = F.regexp_extract(plain, f"^(.*?{vowel})(.*)$", 2)

    def inflected(r: Column) -> Column:
        bare = _reflexive(r)
        other_way = F.when(bare.rlike(ADJECTIVE), _participle(_adjective(bare))).otherwise(_verb(bare))
        return F.when(_gerund(r) != r, _gerund(r)).otherwise(other_way)

    def derived(r: Column) -> Column:
        r = F.regexp_replace(r, "и$", "")
        return F.when(r.rlike(f"{other}{vowel}+{other}+{other}"), F.regexp_replace(r, "(?:ость|ост)$", "")).otherwise(r)

    def ended(r: Column) -> Column:
        r = F.regexp_replace(_noun(r), "ь$", "")
        return F.when(F.concat(head, r).rlike(f"{other}{vowel}$"), r).otherwise(F.regexp_replace(r, "(?:ей|ий|й)$", ""))

    return F.when(head == "", plain).otherwise(F.concat(head, staged(rest, (inflected, derived, ended))))


def staged(value: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    """The steps one after another. Each is a function of a bound variable, so the text of an expression does not double with each."""
    for step in steps:
        value = F.element_at(F.transform(F.array(value), step), 1)
    return value


def stem_en(word: Column) -> Column:
    """The English stem of a word."""
    lower = F.lower(word)
    return F.when(F.char_length(lower) < 3, lower).otherwise(staged(lower, ENGLISH_STEPS))


def stem(word: Column, lang: str = "auto") -> Column:
    """Cyrillic words by the Russian rules unless lang is en, others with Latin letters by the English ones unless lang is ru."""
    lower = F.lower(word)
    russian = lower if lang == "en" else stem_ru(word)
    english = lower if lang == "ru" else stem_en(word)
    return F.when(word.rlike(CYRILLIC), russian).when(word.rlike(LATIN), english).otherwise(lower)


def with_stem(words: DataFrame, word: str, name: str, lang: str = "auto") -> DataFrame:
    """words with stem() of a column, for many words: each step is a projection of its own, which the JVM compiles."""
    lower, english = F.lower(word), F.lit(False) if lang == "ru" else F.col(word).rlike(LATIN) & ~F.col(word).rlike(CYRILLIC) & (F.char_length(F.lower(word)) >= 3)
    out = words.select("*", english.alias("_english"), lower.alias("_stem"))
    for step in ENGLISH_STEPS:
        out = out.withColumn("_stem", F.when(F.col("_english"), step(F.col("_stem"))).otherwise(F.col("_stem")))
    russian = F.col("_stem") if lang == "en" else F.when(F.col(word).rlike(CYRILLIC), stem_ru(F.col(word))).otherwise(F.col("_stem"))
    # a filter on the result stops at the explode; pushed into the steps, it would double with each
    return out.select(*words.columns, F.explode_outer(F.array(russian)).alias(name))


# --- Keyboard layouts --------------------------------------------------------------------------------------------------

# The same keys on both layouts.
RUSSIAN_KEYS = "йцукенгшщзхъфывапролджэячсмитьбю"
ENGLISH_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,."


def layout_ru(word: Column) -> Column:
    """A word typed on the English layout as the Russian one gives it; null if it has no Latin letter or another character."""
    lower = F.lower(word)
    return F.when(lower.rlike(LATIN) & lower.rlike(r"^[a-z\p{Pi}\p{Pf},.;'`-]+$"), F.translate(lower, ENGLISH_KEYS, RUSSIAN_KEYS))


def layout_en(word: Column) -> Column:
    """A word typed on the Russian layout as the English one gives it; null if it has another character than Cyrillic letters."""
    lower = F.lower(word)
    return F.when(lower.rlike("^[а-яё]+$"), F.translate(lower, RUSSIAN_KEYS, ENGLISH_KEYS))
