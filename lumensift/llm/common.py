"""What the operators of this package share: reading a table, and mapping Arrow batches in bounded blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled together in a Python worker; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: crc32(doc_id as text) mod HELD_OUT_MOD = 0 marks the rows that no model learns labels from.
HELD_OUT_MOD = 5


def quoted(name: str) -> str:
    """A column's name for references, whatever it has in it."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (null: empty) alone, so that further columns of docs, whatever their names, cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def held_out(doc_id: Column) -> Column:
    """A null doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD) == 0


def blocks(batch: pa.RecordBatch, at: int = 1, limit: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch whose texts, in column `at`, have about `limit` characters together."""
    start, size, held = 0, 0, []
    for i, text in enumerate(batch.column(at)):
        s = text.as_py()
        held.append(s)
        size += len(s)
        if size >= limit:
            yield batch.slice(start, i + 1 - start), held
            start, size, held = i + 1, 0, []
    if held:
        yield batch.slice(start), held


def slices(batch: pa.RecordBatch, at: int = 1, limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """blocks(), by bytes, without the texts as Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit)) + 1
        yield batch.slice(start, end - start)
        start = end


def map_blocks(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], limit: int = BLOCK_CHARS) -> DataFrame:
    """`work` over blocks of df, whose second column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, strings in blocks(batch, 1, limit):
                yield work(block, strings)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a temporary one if all runs in this machine's one process (tests), else an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = Path(tempfile.mkdtemp(prefix="checkpoint")).as_uri()
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder (or to a path, see new_path()) and read again."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder. What is still there when the driver ends is deleted then."""
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what written() made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, which its owner sizes by the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
