"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumensift.llm import decontamination, media, packing, piece_dropout, quality_classifier, quality_rules, secrets, simhash, suffix_dedup, token_alignment, token_counts, toxicity, vector_codes
from lumensift.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept")
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.round_trip(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_token_counts,
    op2_suffix_dedup,
    op3_quality_classifier,
    op4_quality_rules,
    op5_packing,
    op6_toxicity,
    op7_simhash,
    op8_piece_dropout,
    op9_secrets,
    op10_media,
    op11_token_alignment,
    op12_decontamination,
    op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _rules_sql() -> str:
    tests = []
    for r in quality_rules.RULES:
        value = f"CAST({r.count} AS DOUBLE) / nullif({r.per}, 0)" if r.per else r.count
        bad = [f"{value} {sign} {limit}" for sign, limit in (("<", r.least), (">", r.most)) if limit is not None]
        tests.append(f"coalesce(({' OR '.join(bad)}) AND n_words >= {r.from_words}, FALSE)")
    return " OR ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_WORD = r"[^\x20\x09-\x0D]+"

_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round: all parts against all entries, then the mean of what each entry is nearest to."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
sums{k} AS (
  SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL),
mean{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{k} GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} AS b LEFT JOIN mean{k} AS m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM whole, unnest(range(0, {parts})) AS t(p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {entries}),{",".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


ORACLE_SQL: dict[str, str] = {
    "op12_decontamination": rf"""
WITH split AS (
  SELECT doc_id, {_LOWER_WORDS} AS words FROM documents),
items AS (
  SELECT item_id, {_LOWER_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i : i + 9], ' ') AS w
  FROM items, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0),
found AS (
  SELECT doc_id, i, d.n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS w
        FROM split, unnest(range(1, len(words) + 1)) AS t(i), (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(words)) AS d
  JOIN windows USING (n, w)),
hits AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS names FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op13_vector_codes": _vector_codes_sql(),
    "op4_quality_rules": rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
         len(regexp_extract_all(coalesce(text, ''), '!!')) AS n_exclaimed
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i : i + 4] AS w FROM split, unnest(range(1, len(words) - 3)) AS t(i)),
repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, unnest(range(0, 5)) AS t(k) GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, n_exclaimed,
         len(list_filter(words, lambda w: w IN ({_STOP}))) AS n_stop_words
  FROM split LEFT JOIN covered USING (doc_id)),
base AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_rules_sql()}) AS kept
FROM base""",
}
