"""One object with a method for each operation of a search service. Parameters are coerced as a service coerces those of a request."""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.operators import catalog, facets, rag
from lumensift.operators.highlight import with_fragments
from lumensift.operators.index import SearchIndex, build
from lumensift.operators.search import SearchResult, search
from lumensift.operators.segments import GrowingIndex
from lumensift.operators.suggest import did_you_mean, merged_suggestions
from lumensift.schema import LANGUAGES, AppConfig, small
from lumensift.sources import corpora
from lumensift.sources.state import Store
from lumensift.streaming import learner


def parse_limit(value: Any, default: int) -> int:
    """A whole number not below 0; an empty string is 0; what is no such number, the default."""
    if value is None:
        return default
    try:
        number = float(value or 0)
    except (TypeError, ValueError):
        return default
    return int(number) if math.isfinite(number) and number >= 0 else default


def text_param(value: Any) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def list_param(value: Any) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else value if isinstance(value, list) else []
    return [p.strip() for p in parts if isinstance(p, str) and p.strip()]


def bool_param(value: Any, default: bool) -> bool:
    if isinstance(value, bool):
        return value
    return default if value in (None, "") else str(value).lower() in ("1", "true", "yes", "on")


def lang_param(value: Any) -> str:
    return value if value in LANGUAGES else "auto"


@dataclass
class SearchService:
    spark: SparkSession
    index: SearchIndex
    config: AppConfig = field(default_factory=AppConfig)
    growing: GrowingIndex | None = None  #: where the index lies, if documents are added and deleted in place

    def __post_init__(self) -> None:
        self.started = time.time()
        self.bots = catalog.BotRegistry(self.spark)
        if self.config.bot_name:
            self.bots.register(self.config.bot_name, "telegram")
        self.store = Store(self.spark, self.config.state_path, self.config.backup_dir, self.config.backup_enabled)
        self.queries = learner.replaced(self.store.load())
        self._new: Counter[str] = Counter()

    @classmethod
    def over(cls, docs: DataFrame, config: AppConfig | None = None) -> SearchService:
        config = config or AppConfig()
        return cls(docs.sparkSession, build(docs, config.engine).persist(), config)

    @classmethod
    def on(cls, growing: GrowingIndex, config: AppConfig | None = None) -> SearchService:
        """Over the documents of a growing index, which keeps what add_documents() and delete_documents() change."""
        return cls(growing.spark, growing.view(), config or AppConfig(), growing)

    def _changed(self) -> int:
        self.index = self.growing.view()
        return self.index.corpus[0]

    def add_documents(self, documents: object) -> int:
        """Adds documents (as import_dataset() takes them), or replaces those with their ids. Searches see all of them or none. Returns the number of documents."""
        if self.growing is None:
            raise ValueError("the index does not grow")
        fresh = corpora.from_objects(self.spark, documents)
        last = self.index.doc_stats.agg(F.max("doc_idx")).first()[0]
        self.growing.replace(fresh.withColumn("doc_idx", F.col("doc_idx") + (last + 1)))
        return self._changed()

    def delete_documents(self, ids: list[str]) -> int:
        if self.growing is None:
            raise ValueError("the index does not grow")
        self.growing.delete(small(self.spark, [(i,) for i in ids], "id string"))
        return self._changed()

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "uptime": time.time() - self.started, "docs": self.index.corpus[0], "learn": self.config.learn, "backup": self.store.enabled}

    def _find(self, params: Mapping[str, Any]) -> SearchResult:
        query = next((params[k] for k in ("query", "search", "question") if isinstance(params.get(k), str)), "")
        tags = list_param(params.get("tags")) if "tags" in params else None
        return search(self.index, query, limit=parse_limit(params.get("limit"), self.config.engine.limit), category=text_param(params.get("category")), tags=tags, fuzzy=bool_param(params.get("fuzzy"), True), lang=lang_param(params.get("lang")))

    def search(self, **params: Any) -> dict[str, Any]:
        """query (or search), limit, category, tags (a list, or separated by commas), fuzzy, lang. ValueError without a query."""
        began, result = time.perf_counter(), self._find(params)
        if not result.query:
            raise ValueError("a query is needed")
        hits = [r.asDict() for r in with_fragments(result).orderBy("rank").drop("rank", "doc_idx").collect()]
        hint = None if hits else did_you_mean(result, lang_param(params.get("lang")))
        if self.config.learn == "queries":
            self.remember(result.query)
        return {"query": result.query, "total": result.total, "ms": (time.perf_counter() - began) * 1000, "hits": hits, "did_you_mean": hint}

    def remember(self, query: str) -> None:
        """Counts a query. What was asked since the last flush is kept here, by query."""
        self._new[query] += 1

    def learned(self) -> DataFrame:
        """(query, n): the state with what was asked since."""
        if not self._new:
            return self.queries
        asked = learner.normal(small(self.spark, [*self._new.items()], "query string, n bigint").select("query", "n"), "query", "n")
        return learner.added(self.queries, asked.groupBy("query").agg(F.sum("n").alias("n")))

    def flush(self) -> bool:
        """Saves the counts, and goes on from what was saved; False if the store is not enabled."""
        if not self.store.save(self.learned()):
            return False
        self.queries, self._new = self.store.load(), Counter()
        return True

    def forget(self) -> None:
        """Empties the counts; the store has them until the next flush."""
        self.queries, self._new = self.queries.limit(0), Counter()

    def close(self) -> None:
        """At shutdown: saves what was asked since the last flush, and lets the index go."""
        if self._new:
            self.flush()
        self.index.unpersist()

    def __enter__(self) -> SearchService:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def suggest(self, query: str | None = None, limit: Any = None) -> list[str]:
        if not (query or "").strip():
            return []
        limit = parse_limit(limit, 8)
        popular = learner.top(self.learned(), query, limit) if self.config.learn == "queries" else None
        return [r["word"] for r in merged_suggestions(self.index, query, popular, limit).orderBy("ord").collect()]

    def context(self) -> dict[str, Any]:
        docs = self.index.docs
        counts = {name: {r[0]: r[1] for r in rows.collect()} for name, rows in (("categories", facets.categories(docs)), ("tags", facets.tags(docs)))}
        return {**counts, "stats": facets.statistics(self.index).first().asDict(), "learning": {"mode": self.config.learn, "queries": self.learned().count()}}

    def documents(self, category: Any = None, tag: Any = None, limit: Any = None, offset: Any = None) -> dict[str, Any]:
        category, tag = text_param(category), text_param(tag)
        rows = facets.page(self.index.docs, category, tag, parse_limit(limit, 50), parse_limit(offset, 0))
        return {"total": facets.listing(self.index.docs, category, tag).count(), "documents": [r.asDict() for r in rows.select(*corpora.OUT).collect()]}

    def dataset(self) -> dict[str, Any]:
        """The corpus stays a DataFrame, in order."""
        return {"total": self.index.corpus[0], "documents": self.index.docs.orderBy("doc_idx").select(*corpora.OUT), "learning": learner.snapshot(self.learned())}

    def import_dataset(self, documents: object, path: str | None = None) -> int:
        """Replaces corpus and index, and saves the corpus if a path is given. Returns the number of documents."""
        fresh = build(corpora.from_objects(self.spark, documents), self.config.engine).persist()
        old, self.index = self.index, fresh
        old.unpersist()
        if path:
            corpora.write_dataset(fresh.docs, path)
        return fresh.corpus[0]

    def backup(self) -> str:
        path = self.store.backup(self.learned())
        if path is None:
            raise PermissionError("backups are not enabled")
        return path

    def restore(self) -> dict[str, Any]:
        found = self.store.restore()
        if found is None:
            return {"restored": False}
        self.queries, self._new = learner.replaced(found[1]), Counter()
        return {"restored": True, "snapshot": found[0], "queries": self.queries.count()}

    def providers(self, group: str | None = None, query: str | None = None) -> DataFrame:
        return catalog.providers(self.spark, group, query)

    def ask(self, generate: rag.Generate, **params: Any) -> rag.Answer:
        """query (or question), limit (5), ... ; `generate` gets the prompt and returns the answer."""
        result = self._find({"limit": 5, **params, "fuzzy": True})
        if not result.query:
            raise ValueError("a query is needed")
        return rag.ask(result, generate)
