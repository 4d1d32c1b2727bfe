"""A training corpus from `documents`: rules, near-duplicates, repeated passages, secrets, packing.

Each stage maps a DataFrame with the columns of documents to the next; the last returns packed pieces. run() writes what a
stage keeps to the shared folder and reads it again, so a lost executor costs no more than its stage; what an earlier stage wrote is then deleted.

Other columns may have any names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumensift.llm import packing, quality_rules, secrets, simhash, suffix_dedup
from lumensift.llm.common import new_path, removed, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have no words, so they go. Each row is judged by itself, also one with a null or repeated doc_id."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id stays.

    Null texts are empty; texts without words are in a group with equal texts alone. A null doc_id stays where its group has no id. Rows with one doc_id and one
    text stay or go together, and do not make each other go."""
    return simhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller doc_id has go from the text. Rows stay, even if nothing is left; a null text becomes empty. A
    null doc_id is larger than all others; rows with one doc_id, and those without, do not affect each other."""
    return suffix_dedup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay. Null texts stay null; each row is scanned by itself."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null text is empty, so its end id alone is packed; each row is a document of its own, also one with a null or repeated doc_id."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: SQL has neither the fingerprints nor the tokenizer; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
