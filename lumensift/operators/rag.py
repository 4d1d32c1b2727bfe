"""Contexts and prompts for a language model. Calling one is left to a function that the user gives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumensift.operators.search import SearchResult

EXCERPT = 1500
# The prompt, an entry of its context, and what stands for an empty context.
PROMPT = """\
Ты — поисковый ассистент. Отвечай на языке вопроса (обычно русский).
Отвечай ТОЛЬКО по приведённым ниже результатам поиска. Если в результатах нет ответа — честно скажи «В результатах поиска нет ответа», не выдумывай.
В конце ответа укажи источники номерами [1], [2] и списком ссылок.

Результаты поиска:
{context}

Вопрос: {query}"""
ENTRY = "%s. Заголовок: %s\n   Ссылка: %s\n   Содержимое: %s"
NOTHING = "— результатов нет —"

Generate = Callable[[str], str]


@dataclass(frozen=True)
class Answer:
    query: str
    answer: str
    sources: list[dict[str, str]]


def contexts(result: SearchResult) -> DataFrame:
    """(rank, id, title, link, excerpt) of the hits. A hit's id leads to the first document that has it."""
    ids = result.hits.select("rank", "id")
    first = result.index.docs.join(F.broadcast(ids.select("id").distinct()), "id").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("doc_idx"))).where("n = 1")
    return ids.join(first, "id").select("rank", "id", "title", F.coalesce("link", F.lit("")).alias("link"), F.substring("content", 1, EXCERPT).alias("excerpt"))


def context_text(rows: DataFrame) -> DataFrame:
    """One row, context: the numbered titles, links and excerpts in order."""
    entry = F.format_string(ENTRY, "rank", "title", "link", "excerpt")
    ordered = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n\n").alias("context"))


def prompt(query: str, context: str) -> str:
    return PROMPT.format(context=context or NOTHING, query=query)


def ask(result: SearchResult, generate: Generate) -> Answer:
    """The model's answer over the hits of a search, and its sources by rank."""
    rows = contexts(result)
    found = sorted(rows.collect(), key=lambda r: r["rank"])
    sources = [{"id": str(r["rank"]), "title": r["title"], "link": r["link"]} for r in found]
    return Answer(result.query, generate(prompt(result.query, context_text(rows).first()["context"])), sources)
