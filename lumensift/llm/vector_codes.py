"""Product codes of vectors, with integer codebooks learned by Lloyd rounds.

A component x becomes the integer floor(1024 * x), and a vector PARTS consecutive parts of equal length. The codebook of each part begins as that part of the
first ENTRIES vectors by vec_id. In each round the codebooks, whose size does not grow with the table, are broadcast; tasks find the nearest entry of every part
in Arrow batches (|x|^2 - 2 x.c + |c|^2 over integer matrix products, the first of equal distances) and keep a sum for each entry; sums meet in
one grouped shuffle of at most PARTS * ENTRIES rows a task. So codes, errors and codebooks are exact, on any partitioning.

Rows whose vector is null or has null or non-finite components go. Vectors of different lengths count as filled with zeros up to the longest one's length, rounded up to a multiple
of PARTS; where all are empty, each part is. Fewer than ENTRIES rows: fewer entries. Null vec_ids come last; of rows with one vec_id those with smaller components come first,
and each counts. Components too large for 64-bit products are computed with Python's integers; an error beyond a long is the largest long. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are computed together. Below this size, products of components, their sums over a part of a million and those over 2 ** 43 rows fit into 64 bits. Bits of a digit of larger sums.
TOGETHER, SMALL, LIMB = 2048, 1 << 20, 40
_MOST = (1 << 63) - 1


def _integer(x: float) -> int:
    """floor(SCALE * x), also where the product is beyond all floats."""
    return int(x * SCALE // 1) if abs(x) < 1e300 else int(x) * SCALE


def _whole(vectors: pa.Array, width: int, kind: type) -> np.ndarray:
    """The integers of vectors without nulls, as rows of this width: 64-bit ones, or Python's (kind object)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy()
    whole = np.array([_integer(x) for x in flat.tolist()], object) if kind is object else np.floor(flat * SCALE).astype(np.int64)
    if width and len(sizes) and sizes.min() == sizes.max() == width:
        return whole.reshape(-1, width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equal ones, and its squared distance."""
    if not part.shape[1]:
        return np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    index, distance = [], []
    norms = (book * book).sum(axis=1)
    for a in range(0, len(part), TOGETHER):
        rows = part[a : a + TOGETHER]
        far = norms - 2 * (rows @ book.T)
        best = far.argmin(axis=1).astype(np.int64)
        index.append(best)
        distance.append(far[np.arange(len(rows)), best] + (rows * rows).sum(axis=1))
    return np.concatenate(index), np.concatenate(distance)


def _parts(whole: np.ndarray) -> list[np.ndarray]:
    return np.split(whole, PARTS, axis=1)


def _sums(batches: Iterator[pa.RecordBatch], books: Broadcast, width: int, limbs: int) -> Iterator[pa.RecordBatch]:
    """Of a task, for each part and used entry the number of rows, and the sums of their components as digits of base 1 << LIMB, the last ones signed."""
    kind = books.value[0].dtype.type if books.value[0].dtype != object else object
    counts, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width // PARTS), kind)
    for batch in batches:
        for p, part in enumerate(_parts(_whole(batch.column(1), width, kind))):
            index, _ = _nearest(part, books.value[p])
            counts[p] += np.bincount(index, minlength=ENTRIES)
            order = np.argsort(index, kind="stable")
            used, first = np.unique(index[order], return_index=True)
            if len(used):
                sums[p][used] += np.add.reduceat(part[order], first, axis=0)
    part, entry = np.nonzero(counts)
    rest, digits = sums[part, entry], []
    for _ in range(limbs - 1):
        digits.append((rest & ((1 << LIMB) - 1)).astype(np.int64))
        rest = rest >> LIMB
    flat = np.concatenate([*digits, rest.astype(np.int64)], axis=1)
    arrays = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), arrays], ["part", "entry", "n", "sums"])


def _learned(rows: DataFrame, books: list[np.ndarray], width: int, limbs: int) -> list[np.ndarray]:
    """The codebooks after one round: entries that are nearest to some part become their mean."""
    shared, n = rows.sparkSession.sparkContext.broadcast(books), width // PARTS
    sums = rows.mapInArrow(lambda batches: _sums(batches, shared, width, limbs), "part int, entry int, n long, sums array<long>")
    total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(n * limbs))).alias("sums"))
    out = [book.copy() for book in books]
    for r in total.collect():  # PARTS * ENTRIES rows at most
        out[r.part][r.entry] = [sum(r.sums[j * n + i] << LIMB * j for j in range(limbs)) // r.n for i in range(n)]
    shared.unpersist()
    return out


def _codes(batches: Iterator[pa.RecordBatch], books: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    kind = books.value[0].dtype.type if books.value[0].dtype != object else object
    for batch in batches:
        index, error = [], 0
        for p, part in enumerate(_parts(_whole(batch.column(1), width, kind))):
            own, distance = _nearest(part, books.value[p])
            index.append(own.astype(np.uint8))
            error = error + distance
        raw = np.stack(index, 1).tobytes().hex()
        codes = [raw[i : i + 2 * PARTS] for i in range(0, len(raw), 2 * PARTS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array([min(int(e), _MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) and label of the rows with finite vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label"))
    # null for a null vector, which `where` drops; a comparison with infinity says what is finite, and NaN is above it
    return rows.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The entries of each part, as a matrix of integers, learned from all finite vectors. Without any, they have no rows."""
    rows = kept(vectors).select("vec_id", "vector")
    size, most = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    width = size or 0
    width += -width % PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    bound = abs(_integer(-(most or 0.0)))
    kind, limbs = (np.int64, 1) if bound < SMALL else (object, bound.bit_length() // LIMB + 2)
    books = _parts(_whole(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, kind))
    for _ in range(rounds if width else 0):
        books = _learned(rows, books, width, limbs)
    return books


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each finite vector of vectors(vec_id, embedding, label, ...)."""
    spark, rows, books = vectors.sparkSession, kept(vectors), codebooks(vectors, rounds)
    if not len(books[0]):
        return rows.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    width = PARTS * books[0].shape[1]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)
    kind = rows.schema["label"].dataType.simpleString()
    coded = written(rows.select("vec_id", "vector", "label").mapInArrow(lambda batches: _codes(batches, shared, width), f"vec_id long, label {kind}, code string, error long"))
    # one row a label on this side; Spark broadcasts it if it is small, else splits the skewed partitions of the other
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decoded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id and vector (the mean of what an entry stands for: its components and a half, over SCALE) of rows(vec_id, code)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, PARTS)
            vectors = np.concatenate([(shared.value[p][index[:, p]].astype(np.float64) + 0.5) / SCALE for p in range(PARTS)], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return rows.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")
