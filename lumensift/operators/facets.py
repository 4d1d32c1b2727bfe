"""Counts by category and tag, numbers of an index, pages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.operators.index import SearchIndex
from lumensift.operators.search import passes, rounded


def categories(docs: DataFrame) -> DataFrame:
    """(category, count) over lower-cased categories; empty ones do not count."""
    rows = docs.select(F.lower(F.coalesce("category", F.lit(""))).alias("category")).where("category != ''")
    return rows.groupBy("category").agg(F.count("*").alias("count"))


def tags(docs: DataFrame) -> DataFrame:
    """(tag, count) over lower-cased tags; a tag that a document has twice counts twice."""
    return docs.select(F.explode("tags").alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("count"))


def both(docs: DataFrame) -> DataFrame:
    """(kind, value, count) of categories and tags, from one scan."""
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    category = F.lower(F.coalesce("category", F.lit("")))
    tagged = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: entry("tag", F.lower(t)))
    entries = F.concat(F.when(category != "", F.array(entry("category", category))).otherwise(F.array().cast("array<struct<kind: string, value: string>>")), tagged)
    return docs.select(F.inline(entries)).groupBy("kind", "value").agg(F.count("*").alias("count"))


def cube(docs: DataFrame, bits: int = 12) -> DataFrame:
    """(category, tag, count, n_docs) of each category with each tag, each category, each tag, and all; null stands for any. One scan: the pairs are counted once, and the other
    sets from them. count: tags of documents; n_docs: their distinct documents, estimated by sketches of 2 ** bits registers, which are merged from set to set."""
    rows = docs.select("doc_idx", F.lower(F.coalesce("category", F.lit(""))).alias("category"), F.explode("tags").alias("tag"))
    pairs = rows.groupBy("category", F.lower("tag").alias("tag")).agg(F.count("*").alias("count"), F.hll_sketch_agg("doc_idx", bits).alias("sketch"))
    by = [["category", "tag"], ["category"], ["tag"], []]
    sets = pairs.groupingSets(by, "category", "tag").agg(F.sum("count").alias("count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_docs"))
    return sets.select("category", "tag", "count", "n_docs")


def statistics(index: SearchIndex) -> DataFrame:
    """One row: docs, terms, avg_field_length (two decimals), total_tokens of the bodies."""
    lengths = index.doc_stats.agg(F.count("*").alias("docs"), rounded(F.coalesce(F.avg("doc_len"), F.lit(0.0)), 2).alias("avg_field_length"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_tokens"))
    return lengths.join(index.known().agg(F.count("*").alias("terms")), F.lit(True)).select("docs", "terms", "avg_field_length", "total_tokens")


def listing(docs: DataFrame, category: str | None = None, tag: str | None = None) -> DataFrame:
    return docs.where(passes(category, [tag] if tag else [], None))


def page(docs: DataFrame, category: str | None = None, tag: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents in their order. Without a limit, all from the offset on."""
    rows = listing(docs, category, tag).orderBy("doc_idx").offset(offset)
    return rows if limit is None else rows.limit(limit)
