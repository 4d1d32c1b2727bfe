"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are a ring of four segments of 16. If two fingerprints differ in at most 3 bits, some segment
starts a chain in which, for every length l, the first l segments differ in at most floor(l * 3 / 4) bits together: 0, 1,
2, 3. So the first segment is equal, and of the two halves of the second one at least is equal: the candidates of a
fingerprint share one of 8 keys of 24 bits with it. Candidates that fail the chain's budgets at 2 or 3 segments are
dropped before the full Hamming check.

Equal fingerprints are one row before candidates are sought, however many documents have them. Within a key, links
are reduced to a spanning forest at once, so what leaves a task grows with its rows, not with pairs. A key with very
many different fingerprints is divided again by further segments (exactly: by the pigeonhole principle), never capped.

deduplicated() seeks near copies as five-word shingles define them: each text has six fingerprints of its different words, which
near copies share more of than of their shingles; whose fingerprints are near by any seed is a candidate, and all texts that candidates join
are held to the Jaccard similarity of their shingles. 64 bits of SHA-256 stand for a text, 64-bit hashes for its shingles.

Null text: no words, fingerprint zero, linked like any other. Null doc_id: has a fingerprint, and is the component_id only of
a component without other ids. Repeated rows have equal fingerprints. Fewer than three words: the whole sequence is the one shingle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import checkpointed, map_blocks, partitions, quoted, texts, written
from lumensift.llm.components import components
from lumensift.llm.membership import Members
from lumensift.llm.numbered import within
from lumensift.llm.overlap import overlaps

SEED = 42
#: Fixed value: words are runs of anything but these white-space characters.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
#: A to Z alone are lower-cased.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of fingerprints that are compared with each other directly.
DIRECT = 1024


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """Bit i is 1 if set in over half of the XXH64 values of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = WORDS(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    values = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(values), 65536):
        part = values[a : a + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(values)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def work(block: pa.RecordBatch, strings: list[str]) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle, seed) for t in strings], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(values)], ["doc_id", "fp"])

    return map_blocks(texts(docs), "doc_id long, fp long", work)


def _chains(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether pairs pass: some segment starts a chain within the proportional budgets, and the whole is within the limit."""
    x = a ^ b
    parts = [np.bitwise_count((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(4)]
    chain = np.zeros(len(x), bool)
    for i in range(4):
        total, good = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for n in range(1, 4):
            total += parts[(i + n - 1) % 4]
            good &= total <= n * limit // 4
        chain |= good
    chain[chain] = np.bitwise_count(x[chain]) <= limit
    return chain


def forest(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """spanning(), with the values themselves."""
    a, b = spanning(values, limit)
    return values[a], values[b]


def spanning(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that join what links within `limit` bits join among distinct values; each is such a link or joins the ends of a path of them."""
    root = np.arange(len(values))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def compare(at: np.ndarray) -> None:
        for a in range(0, len(at), DIRECT):
            for b in range(a, len(at), DIRECT):
                i, j = np.meshgrid(at[a : a + DIRECT], at[b : b + DIRECT], indexing="ij")
                i, j = i.ravel(), j.ravel()
                keep = i < j
                i, j = i[keep], j[keep]
                near = _chains(values[i], values[j], limit)
                for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)

    def divide(at: np.ndarray, open_bits: list[int]) -> None:
        """at are equal but for open_bits. Links differ in `limit` of them at most, so of limit + 1 parts one is equal."""
        if len(at) <= DIRECT or len(open_bits) <= limit + 1:
            return compare(at)
        for k in range(limit + 1):
            part = open_bits[k :: limit + 1]
            left = sorted(set(open_bits) - set(part))
            shared = values[at] & np.uint64(sum(1 << b for b in part))
            order = np.argsort(shared, kind="stable")
            for group in np.split(at[order], np.flatnonzero(np.diff(shared[order])) + 1):
                if len(group) > 1:
                    divide(group, left)

    divide(np.arange(len(values)), list(range(64)))
    ends = np.array([find(i) for i in range(len(values))], np.int64)
    moved = np.flatnonzero(ends != np.arange(len(values)))
    return moved, ends[moved]


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of a partition that holds each of its keys whole."""
    held = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int32()), ("fp", pa.int64())]))
    fp = held["fp"].to_numpy().view(np.uint64)
    a, b = close(held["key"].to_numpy(), fp, limit)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (a, b)], ["a", "b"])


def close(key: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of fingerprints that are linked within a key: all near pairs of keys with 64 rows at most, a spanning forest of others."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    size = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]))
    first = np.cumsum(size) - size
    found_a, found_b = [], []
    small = size <= 64
    for gap in range(1, int(size[small].max(initial=1))):  # pairs of small groups, all groups together
        use = small & (size > gap)
        at = np.repeat(first[use], size[use] - gap) + within(size[use] - gap)
        near = _chains(fp[at], fp[at + gap], limit)
        found_a.append(at[near])
        found_b.append(at[near] + gap)
    for a, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
        x, y = spanning(fp[a : a + n], limit)
        found_a.append(a + x)
        found_b.append(a + y)
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *found_a])], order[np.concatenate([none, *found_b])]


def ring_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 keys of each fingerprint: a segment, and a half of the next; and the fingerprints as signed numbers, repeated 8 times."""
    out = []
    for i in range(4):
        segment = (fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        after = (fp >> np.uint64(16 * ((i + 1) % 4))) & np.uint64(0xFFFF)
        for half in (0, 1):
            part = (after >> np.uint64(8 * half)) & np.uint64(0xFF)
            out.append((np.uint64(i << 1 | half) << np.uint64(24) | segment << np.uint64(8) | part).astype(np.int32))
    return np.concatenate(out), np.tile(fp.view(np.int64), 8)


def fingerprint_links(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct.fp that differ in at most `limit` bits (3 at most)."""
    if not 0 <= limit <= 3:
        raise ValueError("the keys are those of at most 3 differing bits")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ring_keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(keys, "key int, fp long").repartition(partitions(distinct), "key")
    return keyed.mapInArrow(lambda batches: _links(batches, limit), "a long, b long")


def near_components(docs: DataFrame, shingle: int = 3, limit: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id reachable over links, itself included) of each row."""
    prints = checkpointed(fingerprints(docs, shingle, seed))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(fingerprint_links(first, limit)).select(F.col("node").alias("fp"), "root")
    rooted = first.join(labels, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Fingerprints of a text that near copies are sought by, and the words of a shingle and the similarity that they are held to.
SEEDS, SHINGLE, SIMILAR = 6, 5, 0.8
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in WORDS(text.translate(LOWER))], np.uint64)


def word_fingerprints(text: bytes, seeds: int = SEEDS) -> np.ndarray:
    """SimHash fingerprints of the different words of a text, by as many seeds."""
    words = np.unique(_word_hashes(text))
    out = np.zeros(seeds, np.uint64)
    for r in range(seeds if len(words) else 0):
        x = (words ^ np.uint64((r + 1) * int(_ODD) & (1 << 64) - 1)) * _MIX
        x = (x ^ x >> np.uint64(29)) * _ODD
        x ^= x >> np.uint64(32)
        counts = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * counts > len(x), bitorder="little").view(np.uint64)[0]
    return out


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the different shingles of n words; of a shorter text, of all its words as one."""
    words = _word_hashes(text)
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = (total ^ words[k : len(words) - n + 1 + k]) * _ODD
        total ^= total >> np.uint64(31)
    return np.unique(total)


def _node(text: Column) -> Column:
    """What stands for a text: 64 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, -10).cast("long")


def _candidate_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a partition that holds each of its keys whole: nodes are joined whose fingerprints under a key are equal, or linked as _links() links them."""
    held = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int32()), ("fp", pa.int64()), ("node", pa.int64())]))
    key, fp, node = (held[c].to_numpy() for c in held.column_names)
    order = np.lexsort((node, fp, key))
    key, fp, node = key[order], fp[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    first = np.flatnonzero(new)
    owner = np.repeat(first, np.diff(np.append(first, len(key))))
    found_a, found_b = [node[~new]], [node[owner][~new]]
    x, y = close(key[first], fp[first].view(np.uint64), limit)
    found_a.append(node[first[x]])
    found_b.append(node[first[y]])
    a, b = least_links(np.concatenate(found_a), np.concatenate(found_b))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def least_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link for each node of the links but the least of its component, to that least one: what many keys have in common then comes out alike."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def similar_links(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, seeds: int = SEEDS, limit: int = 3) -> DataFrame:
    """Links (a, b) between the nodes of different texts, which join what a Jaccard similarity of `similar` or more of the sets of word shingles joins.

    Candidates are found by pigeonring filtering: texts of which, by one seed at least, the fingerprints of the different words differ in `limit`
    bits at most. All texts that candidates join, directly or by others, are then held to each other's shingles."""
    rows = docs.select(_node(F.col("text")).alias("node"), "text")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([word_fingerprints(t.as_buffer().to_pybytes(), seeds) for t in batch.column(1).cast(pa.binary())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(fp.ravel(), seeds).cast(pa.list_(pa.int64()))], ["node", "fps"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, seeds)
            for r in range(seeds):
                key, fp = ring_keys(fps[:, r])
                yield pa.RecordBatch.from_arrays([pa.array(key | np.int32(r << 27)), pa.array(fp), pa.array(np.tile(batch.column(0).to_numpy(), 8))], ["key", "fp", "node"])

    known = rows.mapInArrow(prints, "node long, fps array<long>").dropDuplicates(["node"])
    keyed = known.mapInArrow(keys, "key int, fp long, node long").repartition(partitions(docs), "key")
    links = keyed.mapInArrow(lambda batches: _candidate_links(batches, limit), "a long, b long")

    labels = components(links)
    members = Members(labels, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(members.has(batch.column(0).to_numpy())))
            elements = [shingles(t.as_buffer().to_pybytes(), shingle).view(np.int64) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(elements, pa.list_(pa.int64()))], ["node", "elements"])

    # Members are told in the function that makes the sets: a Python filter before it would give each task a second worker, whose memory stays
    met = rows.select(members.slot(F.col("node")).alias("slot"), "node", "text").mapInArrow(sets, "node long, elements array<long>").dropDuplicates(["node"])
    found = written(met.join(labels, "node").select("root", "node", "elements"))
    return overlaps(found, similar)


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, seeds: int = SEEDS, limit: int = 3) -> DataFrame:
    """The rows of docs(doc_id, text, ...) whose doc_id is the smallest of their group, with all their columns.

    A group is what similar_links() and equal texts join. Null text: empty; texts without words are a group only with texts equal to them. Null doc_id: stays
    where its group has no id. Rows that repeat both doc_id and text stay together, as ties do. Any column names; empty table: no rows."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(F.struct(*(docs[quoted(c)] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), _node(text).alias("node"))
    ids = base.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_if(F.col("doc_id").isNull()).alias("n_null"))
    least = written(ids.select("node", "first_id", (~F.col("first_id").eqNullSafe(F.col("last_id")) | (F.col("n_null") > 0) & F.col("first_id").isNotNull()).alias("several")))
    groups = components(similar_links(docs.select(text.alias("text")), shingle, similar, seeds, limit)).select("node", "root")
    rooted = least.join(groups, "node", "left").select("node", "first_id", "several", F.col("root").isNotNull().alias("joined"), F.coalesce("root", "node").alias("root"))
    affected = rooted.where("several or joined")  # in all other groups one doc_id is all there is, and its rows stay
    of_group = affected.groupBy("root").agg(F.min("first_id").alias("least_id"))
    keeps = F.col("first_id").eqNullSafe(F.col("least_id"))
    verdicts = written(affected.join(of_group, "root").select(F.col("node").alias("of"), keeps.alias("keeps"), "least_id"))
    may_go = Members(verdicts, "of").may_have(F.col("node"))
    goes = (F.col("node") == F.col("of")) & ~(F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("least_id")))
    return base.where(~may_go).select("row.*").unionAll(base.where(may_go).join(verdicts, goes, "left_anti").select("row.*"))
