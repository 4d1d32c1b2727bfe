"""Event-time windows with late and repeated events, and facets from one scan."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lumensift.operators import facets
from lumensift.sources import corpora
from lumensift.streaming import trending

SCHEMA = "id bigint, ts timestamp, who string, query string"


def stream_of(spark, folder, *batches):
    """A stream whose batches come one after another."""
    for i, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "id bigint, ts string, who string, query string").withColumn("ts", F.to_timestamp("ts"))
        made.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        list((folder / "in").glob("*.parquet"))
        yield i, spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")


def test_late_and_repeated_events(spark, tmp_path):
    day = "2024-01-01 "
    first = [(1, day + "10:05:00", "u", " Docker "), (2, day + "10:20:00", "u", "docker"), (2, day + "10:20:00", "u", "docker"), (3, day + "12:00:00", "v", "spark"), (9, day + "10:00:00", "v", "  ")]
    # 4 is late but in time, 3 comes again, 5 comes after its window is final
    second = [(4, day + "11:10:00", "u", "docker"), (3, day + "12:00:00", "v", "spark"), (5, day + "08:00:00", "u", "docker"), (6, day + "20:00:00", "v", "spark")]
    for _, stream in stream_of(spark, tmp_path, first, second):
        rows = trending.events(stream, "query", "ts", "id", "1 hour", "who")
        trending.written(trending.windows(rows, "1 hour", "1 hour"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["start"].strftime("%H"), r["query"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("10", "docker", 2), ("11", "docker", 1), ("12", "spark", 1)}


def test_sessions(spark, tmp_path):
    day = "2024-01-01 "
    rows = [(1, day + "10:00:00", "u", "a"), (2, day + "10:20:00", "u", "b"), (3, day + "11:00:00", "u", "a"), (4, day + "10:10:00", "v", "a"), (5, day + "23:00:00", "v", "a")]
    for _, stream in stream_of(spark, tmp_path, rows):
        found = trending.sessions(trending.events(stream, "query", "ts", "id", "10 minutes", "who"), "who")
        trending.written(found, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["who"], r["start"].strftime("%H:%M"), r["end"].strftime("%H:%M"), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("u", "10:00", "10:50", 2), ("u", "11:00", "11:30", 1), ("v", "10:10", "10:40", 1)}


def test_facets_scan_once(spark, sf_dir):
    plan = facets.both(corpora.parts(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and facets.cube(corpora.documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    odd = spark.createDataFrame([(1, "A", ["x", "X", "y"]), (2, None, None), (3, "", []), (4, "a", ["y", None])], "doc_idx long, category string, tags array<string>")
    assert Counter((r["kind"], r["value"], r["count"]) for r in facets.both(odd).collect()) == Counter([("category", "a", 2), ("tag", "x", 2), ("tag", "y", 2), ("tag", None, 1)])
    assert facets.both(odd.limit(0)).count() == 0


def test_sketches_of_documents(spark):
    """Merged sketches are within a few percent of the distinct documents of each set."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_idx"), F.concat(F.lit("c"), F.col("id") % 3).alias("category"), F.array(F.concat(F.lit("t"), F.col("id") % 5), F.concat(F.lit("t"), F.col("id") % 7)).alias("tags"))
    pairs = docs.select("doc_idx", "category", F.explode("tags").alias("tag"))
    exact = {(r["category"], r["tag"]): (r["count"], r["n"]) for r in pairs.groupingSets([["category", "tag"], ["category"], ["tag"], []], "category", "tag").agg(F.count("*").alias("count"), F.countDistinct("doc_idx").alias("n")).collect()}
    got = {(r["category"], r["tag"]): r for r in facets.cube(docs).collect()}
    assert got.keys() == exact.keys()
    for key, (count, n) in exact.items():
        assert got[key]["count"] == count and abs(got[key]["n_docs"] - n) <= 0.06 * n
