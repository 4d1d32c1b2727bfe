"""The text functions as SQL functions, and a table function that splits texts into words.

register_functions(spark) makes them temporary functions of the session. The scalar ones are SQL bodies, which Catalyst puts in the place of the call, so their
plans have no Python. NFKC normalisation is not among them (Spark lacks it): they take text as text.normalised() gives it. The table function normalises by itself.

    lumen_words(text)      all words, in lower case         lumen_stem(word)      the stem by the word's letters
    lumen_is_stop(word)    whether a word is not indexed    lumen_stem_en, lumen_stem_ru
    lumen_lang(text)       ru or en                         lumen_layout_ru(word), lumen_layout_en(word)

    SELECT explode_outer(words) FROM (SELECT lumen_words(text) AS words FROM docs)   -- a generator's own argument cannot be a SQL function; not explode, for which Spark finds all words twice
    SELECT * FROM lumen_tokenize(TABLE(docs), 'doc_id', 'text')   -- id, pos, word, stop
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lumensift.functions import text as X
from lumensift.functions.split import words
from lumensift.functions.stopwords import STOP_WORDS


def _raw(pattern: str) -> str:
    return 'r"' + pattern.replace('"', r"\x22") + '"'


def _replace(value: str, pattern: str, to: str) -> str:
    return f"regexp_replace({value}, {_raw(pattern)}, {to})"


def _staged(value: str, steps: list[str]) -> str:
    """The steps, expressions of w, one after another. Each binds w anew, so the text grows by a step each time."""
    for step in steps:
        value = f"element_at(transform(array({value}), w -> {step}), 1)"
    return value


def _if_ends(length: int, endings: Iterable[str], value: str) -> str:
    """`value` for words that have one of the endings: few words come to the patterns, which are slow."""
    return f"CASE WHEN right(w, {length}) IN ({', '.join(f"'{x}'" for x in sorted(set(endings)))}) THEN {value} ELSE w END"


def _suffixes(pairs: tuple[tuple[str, str], ...], stem: str) -> str:
    pattern = f"^({stem})({'|'.join(suffix for suffix, _ in pairs)})$"
    to = ", ".join(f"'{suffix}', '{new}'" for suffix, new in pairs)
    replaced = f"CASE WHEN rlike(w, {_raw(pattern)}) THEN concat(regexp_extract(w, {_raw(pattern)}, 1), element_at(map({to}), regexp_extract(w, {_raw(pattern)}, 2))) ELSE w END"
    return _if_ends(2, (suffix[-2:] for suffix, _ in pairs), replaced)


def _english() -> str:
    v, c, vowels = f"[{X.VOWELS}]", f"[^{X.VOWELS}]", X.VOWELS
    mark = r"\x01"
    steps = [
        _if_ends(1, "s", _replace("w", "^(.*(?:ss|i))es$|^(.*[^s])s$", "'$1$2'")),
        f"CASE WHEN endswith(w, 'eed') THEN {_replace('w', f'^(.*{v}.*)eed$', "'$1ee'")} WHEN endswith(w, 'ed') OR endswith(w, 'ing') THEN {_replace('w', f'^(.*{v}.*)(?:ed|ing)$|^(.*(?:ed|ing))$', "concat('$1$2', chr(1))")} ELSE w END",
        f"CASE WHEN NOT endswith(w, chr(1)) THEN w WHEN rlike(w, {_raw(f'(?:at|bl|iz){mark}$')}) OR rlike(w, {_raw(f'^{c}+{v}[^{vowels}wx]{mark}$')}) THEN translate(w, chr(1), 'e') ELSE {_replace('w', rf'([^{vowels}lsz])\1{mark}$|{mark}$', "'$1'")} END",
        _if_ends(1, "y", _replace("w", f"^(.*{v}.*)y$", "'$1i'")),
        _suffixes(X.STEP_2, X.OVER_0),
        _suffixes(X.STEP_3, X.OVER_0),
        _suffixes(X.STEP_4, X.OVER_1),
        _if_ends(1, "e", f"CASE WHEN rlike(w, {_raw(f'^{c}*{v}+{c}*e$')}) AND NOT rlike(w, {_raw(f'{c}{v}[^{vowels}wx]e$')}) THEN {_replace('w', 'e$', "''")} ELSE {_replace('w', f'^({X.OVER_1})e$', "'$1'")} END"),
        _if_ends(1, "lsz", _replace("w", rf"^({X.OVER_1}([lsz]))\2$", "'$1'")),
    ]
    return f"CASE WHEN char_length(lower(word)) < 3 THEN lower(word) ELSE {_staged('lower(word)', steps)} END"


def _russian() -> str:
    vowel, other = f"[{X.RUSSIAN_VOWELS}]", f"[^{X.RUSSIAN_VOWELS}]"
    less = lambda value, pattern: _replace(value, f"^(.*?)(?:{pattern})", "'$1'")
    plain = "translate(lower(word), 'ё', 'е')"
    head, rest = (f"regexp_extract({plain}, {_raw(f'^(.*?{vowel})(.*)$')}, {k})" for k in (1, 2))
    bare = less("w", X.REFLEXIVE)
    inflected = f"CASE WHEN {less('w', X.GERUND)} != w THEN {less('w', X.GERUND)} WHEN rlike({bare}, {_raw(X.ADJECTIVE)}) THEN {less(less(bare, X.ADJECTIVE), X.PARTICIPLE)} ELSE {less(bare, X.VERB)} END"
    steps = [
        inflected,
        _replace("w", "и$", "''"),
        f"CASE WHEN rlike(w, {_raw(f'{other}{vowel}+{other}+{other}')}) THEN {_replace('w', '(?:ость|ост)$', "''")} ELSE w END",
        _replace(less("w", X.NOUN), "ь$", "''"),
        f"CASE WHEN rlike(concat({head}, w), {_raw(f'{other}{vowel}$')}) THEN w ELSE {_replace('w', '(?:ей|ий|й)$', "''")} END",
    ]
    return f"CASE WHEN {head} = '' THEN {plain} ELSE concat({head}, {_staged(rest, steps)}) END"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Of each scalar function its argument, its type, and its body."""
    stops = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    count = lambda pattern: f"regexp_count(text, {_raw(pattern)})"
    english, russian = X.ENGLISH_KEYS.replace("'", r"\'"), X.RUSSIAN_KEYS
    return {
        "lumen_words": ("text", "ARRAY<STRING>", f"CASE WHEN contains(text, 'İ') THEN transform(regexp_extract_all(text, {_raw(X.WORD)}, 0), w -> lower(w)) ELSE regexp_extract_all(lower(text), {_raw(X.WORD)}, 0) END"),
        "lumen_is_stop": ("word", "BOOLEAN", f"word IN ({stops})"),
        "lumen_lang": ("text", "STRING", f"CASE WHEN {count(X.CYRILLIC)} > 0 AND {count(X.CYRILLIC)} >= {count(X.LATIN)} THEN 'ru' ELSE 'en' END"),
        "lumen_stem_en": ("word", "STRING", _english()),
        "lumen_stem_ru": ("word", "STRING", _russian()),
        "lumen_stem": ("word", "STRING", f"CASE WHEN rlike(word, {_raw(X.CYRILLIC)}) THEN {_russian()} WHEN rlike(word, {_raw(X.LATIN)}) THEN {_english()} ELSE lower(word) END"),
        "lumen_layout_ru": ("word", "STRING", rf"""CASE WHEN rlike(lower(word), '[a-z]') AND rlike(lower(word), {_raw(r"^[a-z\p{Pi}\p{Pf},.;'`-]+$")}) THEN translate(lower(word), '{english}', '{russian}') END"""),
        "lumen_layout_en": ("word", "STRING", f"CASE WHEN rlike(lower(word), '^[а-яё]+$') THEN translate(lower(word), '{russian}', '{english}') END"),
    }


class Tokenize:
    """(id, pos, word, stop) of each word of a table's texts, as the index reads them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("the first argument is a table: TABLE(name)")
        kind = rows.dataType[key.value].dataType
        if not isinstance(rows.dataType[text.value].dataType, T.StringType):
            raise ValueError(f"{text.value} is no column of strings")
        return AnalyzeResult(T.StructType([T.StructField("id", kind), T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("stop", T.BooleanType())]))

    def eval(self, row: Row, key: str, text: str) -> Iterator[tuple]:
        own, of = row[key], row[text]
        return ((own, pos, word, word in STOP_WORDS) for pos, word in enumerate(words(of)))


def register_functions(spark: SparkSession) -> list[str]:
    """Makes all functions of this module temporary functions of the session. Returns their names."""
    for name, (argument, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument} STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("lumen_tokenize", F.udtf(Tokenize, useArrow=True))  # else each word is pickled as a row
    return [*bodies(), "lumen_tokenize"]
