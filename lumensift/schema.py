"""The corpus schema and the engine's settings."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A corpus row as engines hold it. keywords_text is what is indexed; doc_idx orders the corpus and breaks ties.
DOC = T.StructType([
    T.StructField("doc_idx", T.LongType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("keywords_text", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("link", T.StringType()),
])
LANGUAGES = ("auto", "ru", "en")


@dataclass(frozen=True)
class EngineConfig:
    """Weights of the fields, BM25 parameters, and defaults of search and snippets. lang chooses the stemmer of the index."""

    title_weight: float = 5.0
    keywords_weight: float = 2.5
    body_weight: float = 1.0
    k1: float = 1.2
    b: float = 0.75
    fuzzy: bool = True
    levenshtein_limit: int = 2
    snippet_width: int = 42
    max_fragments: int = 2
    mark_tag: str = "mark"
    limit: int = 20
    lang: str = "auto"

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> EngineConfig:
        """Each field from SEARCH_<NAME>; what does not parse keeps its default."""
        readers = {"float": as_number, "int": lambda v, d: int(as_number(v, d)), "bool": as_bool, "str": lambda v, d: d if v is None else v}
        return cls(**{f.name: readers[str(f.type)](env.get(f"SEARCH_{f.name.upper()}"), f.default) for f in fields(cls)})


@dataclass(frozen=True)
class AppConfig:
    """Settings of the facade: where state lies, whether it is kept, and whether queries are learned."""

    engine: EngineConfig = field(default_factory=EngineConfig)
    data_path: str = "./data/search-content.json"
    state_path: str = "./data/s-db.json"
    backup_dir: str | None = None
    backup_enabled: bool = True
    learn: str = "dataset"
    bot_name: str | None = None
    ai_provider: str | None = None
    ai_model: str | None = None

    @classmethod
    def from_env(cls, dotenv: str | None = None, env: Mapping[str, str] | None = None) -> AppConfig:
        """The process environment wins over the lines of a .env file."""
        env = {**read_dotenv(dotenv), **(os.environ if env is None else env)}
        base = cls()
        return cls(
            engine=EngineConfig.from_env(env),
            data_path=env.get("SEARCH_DATA", base.data_path),
            state_path=env.get("SEARCH_DB", base.state_path),
            backup_dir=env.get("SEARCH_BACKUP_DIR"),
            backup_enabled=as_bool(env.get("SEARCH_BACKUP"), True),
            learn="queries" if env.get("SEARCH_LEARN") == "queries" else "dataset",
            bot_name=env.get("BOT_NAME", "").strip() or None,
            ai_provider=env.get("AI_PROVIDER", "").strip().lower() or None,
            ai_model=env.get("AI_MODEL", "").strip() or None,
        )


def as_bool(value: str | None, default: bool) -> bool:
    return default if not value else value.lower() in ("1", "true", "yes", "on")


def as_number(value: str | None, default: float) -> float:
    try:
        number = float(value) if value else default
    except ValueError:
        return default
    return number if math.isfinite(number) else default


def read_dotenv(path: str | None) -> dict[str, str]:
    """NAME=value lines; comments, lines without '=' and a missing file give nothing. The first of equal names counts."""
    found: dict[str, str] = {}
    if path and Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.strip().partition("=")
            if equals and not name.startswith("#"):
                found.setdefault(name.strip(), value.strip())
    return found


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table that the plan itself holds, so that no task makes or fetches them."""
    kind = T._parse_datatype_string(schema)
    columns = [*zip(*rows, strict=True)] or [[] for _ in kind.fields]
    table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind.fields, strict=True)], names=kind.names)
    return spark.createDataFrame(table)
