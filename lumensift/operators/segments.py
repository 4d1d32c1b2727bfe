"""An index that grows: segments of documents, tombstones, and a manifest that says which of them count.

A segment is a saved index of the documents that came together. Deleted documents become tombstones of their segments; with them the segment's small tables (terms, forms,
lengths and parts for typos) are written anew: document frequencies lose those of the deleted documents, and only terms with a form that was first seen in one of these are counted again. A merge writes several
segments as one, from their counts by word and document, so no text is read as text again. Each change ends in one commit of the manifest (see sources/versions.py),
and readers have a whole version, the one before or the one after.

view() is a SearchIndex over all live documents, with document frequencies and lengths of all of them: searches give what an index built over the final set gives.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.operators import typos as T
from lumensift.operators.index import SearchIndex, build, of_staged, postings
from lumensift.schema import EngineConfig
from lumensift.sources.versions import VersionLog

SMALL = ("terms", "forms", "doc_stats", "typos")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class GrowingIndex:
    """documents have schema.DOC. doc_idx is theirs to say, and differs between live documents."""

    spark: SparkSession
    path: str
    config: EngineConfig = field(default_factory=EngineConfig)

    @property
    def log(self) -> VersionLog:
        return VersionLog(self.spark, self.path)

    def _read(self, segment: dict[str, Any], name: str, live: bool = True) -> DataFrame:
        """A table of a segment; of those with a row for each document (and word) without deleted documents."""
        folder = segment["tables"] if name in SMALL else segment["folder"]
        rows = self.spark.read.parquet(f"{self.log.full(folder)}/{name}")
        if live and name not in SMALL and segment["gone"]:
            rows = rows.join(self.spark.read.parquet(*map(self.log.full, segment["gone"])).distinct(), "doc_idx", "left_anti")
        return rows

    def _segments(self) -> tuple[int, list[dict[str, Any]]]:
        version, manifest = self.log.latest()
        if manifest and (manifest["typo_limit"], manifest["lang"]) != (self.config.levenshtein_limit, self.config.lang):
            raise ValueError(f"{self.path} was written with another levenshtein_limit or lang")
        return version, manifest.get("segments", [])

    def _described(self, folder: str) -> dict[str, Any]:
        row = self.spark.read.parquet(f"{self.log.full(folder)}/doc_stats").agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total")).first()
        return {"n": row["n"], "total": int(row["total"])}

    def _commit(self, segments: list[dict[str, Any]], after: int) -> None:
        self.log.commit({"segments": [s for s in segments if s["n"]], "typo_limit": self.config.levenshtein_limit, "lang": self.config.lang}, after)

    def _new_segment(self, index: SearchIndex) -> dict[str, Any]:
        folder = self.log.new_folder()
        index.save(self.log.full(folder))
        return {"folder": folder, "tables": folder, "gone": [], **self._described(folder)}

    def add(self, docs: DataFrame) -> None:
        """A segment of new documents. ValueError if a live document has one of their doc_idx."""
        version, segments = self._segments()
        if segments:
            known = _union([self._read(s, "doc_stats").select("doc_idx") for s in segments])
            if not docs.select("doc_idx").join(known, "doc_idx", "left_semi").isEmpty():
                raise ValueError("a live document has this doc_idx")
        self._commit([*segments, self._new_segment(build(docs, self.config))], version)

    def delete(self, ids: DataFrame) -> None:
        """Deletes the documents of ids(id)."""
        version, segments = self._segments()
        self._commit([self._without(s, ids) for s in segments], version)

    def replace(self, docs: DataFrame) -> None:
        """Adds documents, and deletes those with the same id, in one version."""
        version, segments = self._segments()
        ids = docs.select("id").distinct()
        self._commit([*(self._without(s, ids) for s in segments), self._new_segment(build(docs, self.config))], version)

    def _without(self, segment: dict[str, Any], ids: DataFrame) -> dict[str, Any]:
        gone = self._read(segment, "docs").join(ids.select("id").distinct(), "id", "left_semi").select("doc_idx")
        folder = self.log.new_folder()
        at = self.log.full(folder)
        gone.write.parquet(f"{at}/gone")
        gone = self.spark.read.parquet(f"{at}/gone")
        if gone.isEmpty():
            return segment
        after = {**segment, "gone": [*segment["gone"], f"{folder}/gone"], "tables": folder}
        lost = self._read(segment, "staged").where("new").join(gone, "doc_idx", "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
        forms = self._read(segment, "forms")
        moved = forms.withColumn("doc_idx", F.col("first_pos.doc_idx")).join(gone, "doc_idx", "left_semi").select("term").distinct()
        moved.write.parquet(f"{at}/moved")
        moved = self.spark.read.parquet(f"{at}/moved")
        counted = of_staged(self._read(after, "docs"), self._read(after, "staged").join(moved, "term", "left_semi"), self.config)
        less = self._read(segment, "terms").join(lost, "term", "left").withColumn("df", F.col("df") - F.coalesce("lost", F.lit(0))).drop("lost")
        for name, kept in (("terms", less), ("forms", forms)):
            rows = kept.join(moved, "term", "left_anti").unionByName(getattr(counted, name))
            rows.repartition("term").sortWithinPartitions("term").write.parquet(f"{at}/{name}")
        self._read(segment, "doc_stats").join(gone, "doc_idx", "left_anti").write.parquet(f"{at}/doc_stats")
        entries = T.entries(self.spark.read.parquet(f"{at}/terms"), self.config.levenshtein_limit)
        entries.repartition("part").sortWithinPartitions("part").write.parquet(f"{at}/typos")
        return {**after, **self._described(folder)}

    def merge(self, most: int = 1) -> None:
        """Writes the smallest segments and those with tombstones as one, so that at most `most` are left."""
        version, segments = self._segments()
        by_size = sorted(segments, key=lambda s: s["n"])
        smallest = by_size[: len(segments) - most + 1] if len(segments) > most else []
        chosen = [s for s in segments if s in smallest or s["gone"]]
        if not chosen:
            return
        docs, staged = (_union([self._read(s, name) for s in chosen]) for name in ("docs", "staged"))
        merged = self._new_segment(of_staged(docs, staged, self.config))
        self._commit([*(s for s in segments if s not in chosen), merged], version)

    def prune(self) -> None:
        """Deletes what the last two versions do not name."""
        log = self.log
        files = [n for n in log.names("log") if n.endswith(".json")][-2:]
        named = {name.split("/")[0] for n in files for s in (log._read(n) or {}).get("segments", []) for name in (s["folder"], s["tables"], *s["gone"])}
        log.pruned(named)

    def view(self) -> SearchIndex:
        """The last version as one index. Look-ups by term or part reach the scans of all segments."""
        _, segments = self._segments()
        if not segments:
            raise ValueError(f"{self.path} has no documents")
        tables = {name: _union([self._read(s, name) for s in segments]) for name in ("docs", "staged", *SMALL)}
        if len(segments) > 1:
            first = F.min("first_pos").alias("first_pos")
            tables["terms"] = tables["terms"].groupBy("term").agg(F.sum("df").alias("df"), first)
            tables["forms"] = tables["forms"].groupBy("term", "word").agg(first)
            tables["typos"] = tables["typos"].groupBy(*T.KEY, "term", "letters").agg(first)
        n, total = (sum(s[k] for s in segments) for k in ("n", "total"))
        return SearchIndex(tables["docs"], postings(tables["staged"]), tables["terms"], tables["forms"], tables["doc_stats"], self.config, (n, total / n), tables["staged"], tables["typos"])
