"""A log of versions in a folder that every executor reaches: data first, then one small commit file.

A version is a JSON text in <folder>/log/<number>.json, made by a create that fails where the file is there already, so of two writers one alone commits. Its last
key says that it is whole; a file that a stopped writer left without that counts as none. Nothing is renamed, and what earlier versions name stays until
pruned() is called after a later commit, so at every moment the last whole version has all its data.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass(frozen=True)
class VersionLog:
    spark: SparkSession
    path: str

    def _at(self, *names: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *names)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def names(self, *folder: str) -> list[str]:
        system, place = self._at(*folder)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def new_folder(self) -> str:
        """The name of a folder for data that a later commit names."""
        return f"v-{uuid.uuid4().hex}"

    def full(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _read(self, name: str) -> dict[str, Any] | None:
        system, place = self._at("log", name)
        stream = system.open(place)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and found.pop("whole", False) else None

    def latest(self) -> tuple[int, dict[str, Any]]:
        """The number and the content of the last whole version; 0 and {} if there is none."""
        for name in reversed([n for n in self.names("log") if n.endswith(".json") and not n.startswith(".")]):
            if (found := self._read(name)) is not None:
                return int(name.removesuffix(".json")), found
        return 0, {}

    def commit(self, content: dict[str, Any], after: int) -> int:
        """Makes `content` the version that follows `after`, the last one that the writer has seen."""
        numbers = [int(n.removesuffix(".json")) for n in self.names("log") if n.endswith(".json") and not n.startswith(".")]
        if self.latest()[0] != after:
            raise Conflict(f"{self.path} has a version after {after}")
        number = max([after, *numbers]) + 1  # after files that are not whole, too
        system, place = self._at("log", f"{number:010d}.json")
        try:
            out = system.create(place, False)
        except Exception as e:
            raise Conflict(f"{self.path} has a version {number}") from e
        out.write(bytearray(json.dumps({**content, "whole": True}).encode()))
        out.close()
        return number

    def pruned(self, named: set[str], keep: int = 2) -> None:
        """Deletes the log but for its last `keep` files, and data folders that are not `named`. To be called by the writer, when no reader has older versions open."""
        log = [n for n in self.names("log") if n.endswith(".json")]
        for old in log[:-keep]:
            self._delete("log", old)
        for name in self.names():
            if name.startswith("v-") and name not in named:
                self._delete(name)

    def _delete(self, *names: str) -> None:
        system, place = self._at(*names)
        system.delete(place, True)
