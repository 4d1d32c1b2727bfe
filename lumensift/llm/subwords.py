"""Hashed character n-grams of words, and the bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import held_out, texts


#: Words whose n-grams are made together, which bounds the memory.
TOGETHER = 50_000


def ngram_buckets(words: list[str], low: int, high: int, bits: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (0 to 2**bits - 1) of the n-grams, low to high characters long, of each word between marks of its ends, and where
    each word's begin (then the end). whole: the word itself comes first. Characters are code points."""
    parts = [_ngram_buckets(words[a : a + TOGETHER], low, high, bits, whole) for a in range(0, len(words), TOGETHER)]
    sizes = np.concatenate([[0], *(n for _, n in parts)]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int32), *(b for b, _ in parts)]), np.cumsum(sizes)


def _ngram_buckets(words: list[str], low: int, high: int, bits: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for a few words, with the number of buckets of each."""
    marked = [f"\x02{w}\x03" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(chars))  # characters from here to the word's end
    odd = np.uint64(0x9E3779B97F4A7C15)
    found, of = [], []

    def put(values: np.ndarray, word: np.ndarray, salt: int) -> None:
        values = (values ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ values >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        found.append((values >> np.uint64(64 - bits)).astype(np.int32))
        of.append(word)

    if whole:
        power = np.ones(int(sizes.max()), np.uint64)
        power[1:] = odd
        power = np.multiply.accumulate(power)
        put(np.add.reduceat(chars * power[sizes[owner] - left], ends - sizes), np.arange(len(words)), 1)
    rolled = chars
    for n in range(2, high + 1):
        rolled = rolled[:-1] * odd + chars[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n >= low and len(rolled):
            good = left[: len(rolled)] >= n
            put(rolled[good], owner[: len(rolled)][good], n)
    bucket, word = np.concatenate(found), np.concatenate(of)
    return bucket[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def segment_sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of values[begins[i] : begins[i + 1]]."""
    if len(begins) == 1:
        return np.zeros((0, *values.shape[1:]), values.dtype)
    out = np.zeros((len(begins) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        out[full] = np.add.reduceat(values, begins[full], axis=0)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> Iterator[tuple[str, int]]:
    """(text, label) of at most `rows` labelled documents, and no more than `most_bytes` of text, whose crc32(doc_id) mod 5 is not 0.

    A third of the rows at least, if there are so many, has the rarer label. Which rows: the smallest hashes of doc_id. Texts
    are taken whole; one that does not fit is left out. Each label has room for a third of the bytes, or for all or the shortest of its
    texts, if there are less or it is longer. doc_id only chooses rows; it is no feature."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    at = F.xxhash64("doc_id", F.lit(7))
    chosen = [r for y in (0, 1) for r in wanted.where(F.col("label") == y).orderBy(at).limit(rows).select("doc_id", "label", at.alias("at")).collect()]
    by = {y: sorted((r["at"], r["doc_id"]) for r in chosen if r["label"] == y) for y in (0, 1)}
    rare = min(by, key=lambda y: len(by[y]))
    n_rare = min(len(by[rare]), max(rows // 3, round(rows * len(by[rare]) / max(1, len(chosen)))))
    picked = {i: rare for _, i in by[rare][:n_rare]} | {i: 1 - rare for _, i in by[1 - rare][: rows - n_rare]}
    if not picked:
        return
    spark = docs.sparkSession
    ids = spark.createDataFrame([*picked.items()], "doc_id long, label int")  # at most `rows`
    found = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("which"))
    # of a doc_id with several texts one is chosen, so `rows` bounds what comes to the driver; first sizes, then the texts that fit
    sizes = found.groupBy("doc_id").agg(F.min(F.struct("which", "size")).alias("text"), F.xxhash64("doc_id", F.lit(11)).alias("at")).collect()
    sized = sorted((r["at"], r["doc_id"], r["text"]["which"], r["text"]["size"]) for r in sizes)
    of_label = {y: [n for _, i, _, n in sized if picked[i] == y] for y in (0, 1)}
    least = {y: min((n for n in found_ if n), default=0) for y, found_ in of_label.items()}
    room = {y: max(min(most_bytes // 3, sum(n)), least[y]) for y, n in of_label.items() if least[y] <= most_bytes}
    used, taken = {0: 0, 1: 0}, {}
    for _, i, which, n in sized:
        y = picked[i]
        if used[y] + n + max(used[1 - y], room.get(1 - y, 0)) <= most_bytes:
            used[y] += n
            taken[i] = which
    if not taken:
        return
    wanted = F.broadcast(spark.createDataFrame([*taken.items()], "doc_id long, which long"))
    texts_ = {r["doc_id"]: r["text"] for r in found.join(wanted, ["doc_id", "which"]).select("doc_id", "text").dropDuplicates(["doc_id"]).collect()}
    for _, i, _, _ in sized:
        if i in texts_:
            yield texts_[i], picked[i]
