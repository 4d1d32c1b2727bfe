"""State of learning: how often each query was asked, with snapshots to go back to.

Counts lie in parts by a hash of the query, as Parquet in a folder that every executor reaches. A version (see versions.py) names the folder of each part; a writer
makes new folders, then commits, and readers take the last whole version. A stream's batch writes only the parts that its queries fall into, and its
number is committed with them, so a batch that is repeated changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.sources.versions import VersionLog

QUERIES = "query string, n bigint"


def put(spark: SparkSession, aside: str, path: str, keep: str | None = None) -> None:
    """Puts a finished folder in the place of another, which goes (to `keep`, if given) only when the new one is there. An error if a step fails."""
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, to, old = files.Path(aside), files.Path(path), files.Path(keep or f"{path.rstrip('/')}.old")
    system = to.getFileSystem(conf)
    system.mkdirs(to.getParent())
    if system.exists(to):  # else a writer stopped between its moves, and `old` may be all that there is
        system.delete(old, True)
        if not system.rename(to, old):
            raise OSError(f"{path} cannot be moved aside")
    if not system.rename(new, to):
        raise OSError(f"{aside} cannot be moved to {path}")
    if not keep:
        system.delete(old, True)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    backup_dir: str | None = None
    enabled: bool = True
    parts: int = 16

    @property
    def log(self) -> VersionLog:
        return VersionLog(self.spark, self.path)

    @property
    def backups(self) -> str:
        return self.backup_dir or f"{self.path.rstrip('/')}-backups"

    @property
    def snapshot_log(self) -> VersionLog:
        return VersionLog(self.spark, self.backups)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("query"), F.lit(self.parts)).cast("int")

    def _write(self, queries: DataFrame, path: str) -> dict[str, str]:
        """Writes (query, n) by part: the folder of each part that has rows, below `path`."""
        rows = queries.select("query", F.col("n").cast("bigint").alias("n"), F.current_timestamp().alias("saved_at")).withColumn("part", self._part())
        rows.repartition("part").write.partitionBy("part").parquet(path)
        log = VersionLog(self.spark, path)
        return {name.removeprefix("part="): name for name in log.names() if name.startswith("part=")}

    def _read(self, log: VersionLog, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], QUERIES)
        return self.spark.read.schema(f"{QUERIES}, saved_at timestamp").parquet(*map(log.full, folders)).select("query", "n")

    def _state(self) -> tuple[int, dict[str, Any]]:
        version, content = self.log.latest()
        if content and content["of"] != self.parts:
            raise ValueError(f"{self.path} has {content['of']} parts, not {self.parts}")
        return version, content

    def clear(self) -> bool:
        """Forgets all queries; snapshots stay."""
        return self.save(self.spark.createDataFrame([], QUERIES))

    def load(self) -> DataFrame:
        """(query, n); no rows if there is no state, or none that can be read."""
        try:
            state = self._read(self.log, [*self.log.latest()[1].get("parts", {}).values()])
            state.limit(1).collect()  # a file that cannot be read says so only now
            return state
        except (PySparkException, Py4JJavaError):
            return self.spark.createDataFrame([], QUERIES)

    def _commit(self, parts: dict[str, str], version: int, **more: Any) -> None:
        log = self.log
        before = {name.split("/")[0] for name in log.latest()[1].get("parts", {}).values()}
        log.commit({"of": self.parts, "parts": parts, **more}, version)
        log.pruned({*before, *(name.split("/")[0] for name in parts.values())})  # who reads the version before still can

    def save(self, queries: DataFrame) -> bool:
        """All counts anew. False, and nothing is written, if the store is not enabled."""
        if not self.enabled:
            return False
        version, content = self.log.latest()
        folder = self.log.new_folder()
        parts = {p: f"{folder}/{name}" for p, name in self._write(queries, self.log.full(folder)).items()}
        self._commit(parts, version, batches=content.get("batches", {}))
        return True

    def merge(self, changed: DataFrame, batch: int, stream: str = "") -> list[int]:
        """Puts new counts of some queries in the place of their old ones, as batch number `batch` of a stream. Returns the parts that were written anew: none if the batch,
        or a later one, was merged before."""
        if not self.enabled:
            return []
        version, content = self._state()
        batches, parts = content.get("batches", {}), content.get("parts", {})
        if batches.get(stream, -1) >= batch:
            return []
        changed = changed.select("query", "n").persist()  # counted and written: the stream would work it out twice
        try:
            touched = sorted(r["part"] for r in changed.select(self._part().alias("part")).distinct().collect())  # `parts` at most
            old = self._read(self.log, [parts[str(p)] for p in touched if str(p) in parts])
            folder = self.log.new_folder()
            made = self._write(old.join(changed, "query", "left_anti").unionByName(changed), self.log.full(folder)) if touched else {}
        finally:
            changed.unpersist()
        self._commit({**parts, **{p: f"{folder}/{name}" for p, name in made.items()}}, version, batches={**batches, stream: batch})
        return touched

    def backup(self, queries: DataFrame) -> str | None:
        """The new snapshot's folder; None if the store is not enabled. A failure to write is raised."""
        if not self.enabled:
            return None
        name = f"s-backup-{datetime.now(UTC).strftime('%Y-%m-%dT%H-%M-%S-%fZ')}"
        self._write(queries, self.snapshot_log.full(name))
        return self.snapshot_log.full(name)

    def snapshots(self) -> list[str]:
        """Names of snapshots that were written to the end, newest first."""
        log = self.snapshot_log
        return sorted((n for n in log.names() if n.startswith("s-backup-") and "_SUCCESS" in log.names(n)), reverse=True)

    def restore(self) -> tuple[str, DataFrame] | None:
        """The newest snapshot's name and queries, which also become the state if the store is enabled; None if there is no snapshot."""
        names = self.snapshots()
        if not names:
            return None
        log = self.snapshot_log
        queries = self._read(log, [f"{names[0]}/{part}" for part in log.names(names[0]) if part.startswith("part=")])
        self.save(queries)
        return names[0], queries
