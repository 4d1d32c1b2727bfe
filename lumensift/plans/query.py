"""The query language: +required -excluded "phrase" @category #tag and plain words.

A quoted part of more than two characters is a phrase; of phrases and of categories the last counts. A sign alone is a word.
parse() is for one query on the driver; parsed_columns() does the same to a column of queries.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumensift.functions import text as X

#: A quoted part, or a run without white space.
PART = r'"(?:[^"]*)"|\S+'
_PARTS = re.compile(PART)


@dataclass
class ParsedQuery:
    required: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    phrase: str | None = None
    category: str | None = None
    tags: list[str] = field(default_factory=list)


#: What a part is by its sign, and what becomes of the rest of it.
SIGNS: dict[str, tuple[str, Callable[[str], str]]] = {"+": ("required", str), "-": ("excluded", str), "@": ("categories", str.lower), "#": ("tags", str.lower)}
_KIND = re.compile(rf'"(?P<phrase>.+)"|(?P<sign>[{re.escape("".join(SIGNS))}])(?P<rest>.+)|(?P<word>.+)', re.DOTALL)


def _kind(part: str) -> tuple[str, str]:
    m = _KIND.fullmatch(part)
    if m["sign"]:
        kind, change = SIGNS[m["sign"]]
        return kind, change(m["rest"])
    return ("phrases", m["phrase"].strip()) if m["phrase"] is not None else ("words", m["word"])


def parse(raw: str) -> ParsedQuery:
    by: dict[str, list[str]] = defaultdict(list)
    for kind, value in map(_kind, _PARTS.findall(unicodedata.normalize("NFKC", raw))):
        by[kind].append(value)
    last = lambda kind: by[kind][-1] if by[kind] else None
    return ParsedQuery(by["required"], by["excluded"], by["words"], last("phrases"), last("categories"), by["tags"])


def parts_of(query: Column) -> Column:
    """The parts of a query column, for parsed_columns()."""
    return F.regexp_extract_all(X.nfkc(F.trim(query)), F.lit(PART), 0)


def parsed_columns(query: Column, parts: Column | None = None) -> dict[str, Column]:
    """required, excluded, words, tags (arrays), phrase and category (null if there is none) of a query column. parts: a column of rows that has parts_of() it; else
    each of the results normalises and cuts the query again."""
    parts = parts_of(query) if parts is None else parts

    def signed(sign: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p.startswith(sign) & (F.char_length(p) > 1)), lambda p: F.substring(p, 2, 1 << 30))

    def is_phrase(p: Column) -> Column:
        return p.startswith('"') & p.endswith('"') & (F.char_length(p) > 2)

    def is_plain(p: Column) -> Column:
        return ~is_phrase(p) & ~(F.left(p, F.lit(1)).isin(*SIGNS) & (F.char_length(p) > 1))

    phrases = F.transform(F.filter(parts, is_phrase), lambda p: F.trim(F.substring(p, F.lit(2), F.char_length(p) - 2)))
    lowered = lambda sign: F.transform(signed(sign), F.lower)
    return {
        "required": signed("+"),
        "excluded": signed("-"),
        "words": F.filter(parts, is_plain),
        "phrase": F.try_element_at(phrases, F.lit(-1)),
        "category": F.try_element_at(lowered("@"), F.lit(-1)),
        "tags": lowered("#"),
    }
