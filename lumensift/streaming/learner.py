"""How often queries are asked: counts of a table, or of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumensift.sources.state import Store


def normal(queries: DataFrame, column: str = "query", *more: str) -> DataFrame:
    """Trimmed lower-case queries, with further columns; empty ones go."""
    return queries.select(F.lower(F.trim(column)).alias("query"), *more).where("query != ''")


def remember(queries: DataFrame, column: str = "query") -> DataFrame:
    """(query, n) of a table, or of a stream, of queries."""
    return normal(queries, column).groupBy("query").agg(F.count("*").alias("n"))


def added(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.select("query", "n").union(more.select("query", "n")).groupBy("query").agg(F.sum("n").alias("n"))


def replaced(state: DataFrame) -> DataFrame:
    """Counts of a state that is taken over: whole numbers, 1 at least."""
    return state.select("query", F.greatest(F.lit(1), F.floor("n")).cast("bigint").alias("n"))


def snapshot(state: DataFrame) -> DataFrame:
    return state.orderBy(F.desc("n"), "query")


def top(state: DataFrame, prefix: str = "", limit: int = 8) -> DataFrame:
    """(ord, query, n): the queries with a prefix that were asked most; ties in the order of their text."""
    best = state.where(F.col("query").startswith(prefix.strip().lower())).orderBy(F.desc("n"), "query").limit(limit)
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "query"))).alias("rows"))  # at most `limit` rows
    return rows.select(F.posexplode("rows").alias("pos", "r")).select((F.col("pos") + 1).alias("ord"), "r.query", (-F.col("r.less")).alias("n"))


def learn_stream(queries: DataFrame, store: Store, checkpoint: str, column: str = "query", interval: str | None = None) -> StreamingQuery:
    """Keeps the store's state up to date with a stream of queries.

    Counts are the stream's own state; of each batch the queries whose counts changed are merged into the store's parts that they fall into, and the batch's number is committed with them, so
    a repeated batch changes nothing. `interval` is the time between writes; without it, what is there is taken and the stream ends. The store must be this stream's own."""
    writer = remember(queries, column).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, number: store.merge(batch, number, checkpoint) and None)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
