"""Corpora: JSON datasets in and out, and adapters of tables to the corpus schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.schema import DOC
from lumensift.sources.state import put

#: A document as datasets have it. keywords is an array or a string, so it is read as the JSON text that it is.
RAW = "id string, title string, content string, keywords string, tags array<string>, category string, link string"
OUT = ("id", "title", "content", "keywords", "tags", "category", "link")


def as_corpus(rows: DataFrame) -> DataFrame:
    """Rows of RAW with doc_idx as schema.DOC. Rows without id, title or content go; the others keep their numbers.

    A keyword string is indexed as it is and given out split at commas and white space; an array is indexed joined by spaces."""
    listed = F.from_json("keywords", "array<string>")
    is_array = F.col("keywords").startswith("[")
    split = F.filter(F.split("keywords", r"[,\s]+"), lambda k: k != "")
    valid = rows.where("id is not null and title is not null and content is not null")
    return valid.select(
        "doc_idx",
        "id",
        "title",
        "content",
        F.when(is_array, listed).otherwise(split).alias("keywords"),
        F.when(is_array, F.array_join(listed, " ")).otherwise(F.col("keywords")).alias("keywords_text"),
        "tags",
        "category",
        "link",
    )


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with an array of documents, or {"documents": [...]}. One file is one JSON value, which one task reads; large corpora come as JSON lines or Parquet."""
    text = spark.read.text(path, wholetext=True)
    array = f"array<{T._parse_datatype_string(RAW).simpleString()}>"
    inner = F.coalesce(F.get_json_object("value", "$.documents"), F.col("value"))
    return as_corpus(text.select(F.posexplode(F.from_json(inner, array)).alias("doc_idx", "d")).select(F.col("doc_idx").cast("long").alias("doc_idx"), "d.*"))


def read_lines(spark: SparkSession, path: str, order: str = "id") -> DataFrame:
    """JSON lines, numbered by the given field."""
    rows = spark.read.schema(RAW).json(path)
    return as_corpus(numbered(rows, order))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """doc_idx from 0 by `order`, without one task that sees all rows: places within ranges plus the sizes of earlier ranges. The ranges are
    written to the checkpoint folder (or kept, where there is none), so that the numbers do not change when rows are read again."""
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    ranged = placed.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else placed.persist()
    part = F.shiftright("at", 33)
    sizes = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, first = {}, 0
    for p in sorted(sizes):
        before[p] = first
        first += sizes[p]
    if not before:
        return ranged.withColumnRenamed("at", "doc_idx")
    starts = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))
    return ranged.withColumn("doc_idx", F.element_at(starts, part.cast("long")) + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def from_objects(spark: SparkSession, documents: object) -> DataFrame:
    """Parsed JSON (a list, or a mapping with documents) as a corpus. ValueError if it is no list, or no document of it is valid."""
    if isinstance(documents, dict):
        documents = documents.get("documents")
    if not isinstance(documents, list):
        raise ValueError("documents must be an array")
    good = []
    for i, d in enumerate(documents):
        if isinstance(d, dict) and all(isinstance(d.get(k), str) for k in ("id", "title", "content")):
            words, tags = d.get("keywords"), d.get("tags")
            keywords = json.dumps(words, ensure_ascii=False) if isinstance(words, list) else words if isinstance(words, str) else None
            good.append((len(good), d["id"], d["title"], d["content"], keywords, [str(t) for t in tags] if isinstance(tags, list) else None, _text(d.get("category")), _text(d.get("link"))))
    if not good:
        raise ValueError("no valid document")
    return as_corpus(spark.createDataFrame(good, "doc_idx long, " + RAW))


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def export(docs: DataFrame) -> DataFrame:
    """(doc_idx, json) of each document, without its empty fields."""
    return docs.select("doc_idx", F.to_json(F.struct(*OUT)).alias("json"))


def write_dataset(docs: DataFrame, path: str) -> None:
    """JSON lines in a folder, written aside and renamed; an earlier one is kept beside it as <path>.previous."""
    spark = docs.sparkSession
    docs.select(*OUT).write.mode("overwrite").json(f"{path}.new")
    put(spark, f"{path}.new", path, keep=f"{path}.previous")


# --- Tables ------------------------------------------------------------------------------------------------------------


def _corpus(df: DataFrame, **columns: Column) -> DataFrame:
    columns.setdefault("keywords_text", F.array_join(columns["keywords"], " "))
    return df.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in DOC.fields))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents; a title is a text's first line."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tags = F.array("lang", "source")
    return _corpus(df, doc_idx=F.col("doc_id"), id=F.col("doc_id"), title=F.substring_index("text", "\n", 1), content=F.col("text"), keywords=tags, tags=tags, category=F.col("lang"), link=F.concat(F.lit("/doc/"), F.col("doc_id")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table part; names are titles."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    none = F.lit(None).cast("array<string>")
    return _corpus(df, doc_idx=F.col("p_partkey"), id=F.col("p_partkey"), title=F.col("p_name"), content=F.concat_ws(" ", "p_type", "p_brand"), keywords=none, tags=F.array("p_brand"), category=F.col("p_type"), link=F.concat(F.lit("/part/"), F.col("p_partkey")))
