"""What is asked most lately, from a stream of events with times: counts in sliding windows, and sessions.

Events may come late by `late`, and twice within that time; what comes later still is dropped. A window's row is given out once, when no event for it can come any more.
The state that Spark keeps is that of open windows, open sessions, and of the keys of the last `late`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.streaming.learner import normal


def events(stream: DataFrame, query: str, time: str, key: str, late: str, *more: str) -> DataFrame:
    """(query, time, ...) of normal queries, each event once by its key."""
    rows = normal(stream.select(query, F.col(time).cast("timestamp").alias("time"), F.col(key).alias("key"), *more), query, "time", "key", *more)
    return rows.withWatermark("time", late).dropDuplicatesWithinWatermark(["key"])


def windows(rows: DataFrame, length: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """(start, end, query, n) of events() in sliding windows."""
    counts = rows.groupBy(F.window("time", length, step), "query").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "query", "n")


def sessions(rows: DataFrame, who: str, gap: str = "30 minutes") -> DataFrame:
    """(who, start, end, n) of events() whose neighbours are no more than a gap apart."""
    counts = rows.groupBy(F.session_window("time", gap), who).agg(F.count("*").alias("n"))
    return counts.select(who, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def written(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is final to a folder of Parquet, from all that is there, and ends."""
    rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
