"""Links between sets with a Jaccard similarity of a limit or more, within groups of candidates.

A group is compared in tasks of about BLOCK elements: a larger one is dealt into parts, and each two parts meet in a task, so no task holds a whole
group and no pair of sets goes unseen. Within a task, sets that share no element of their rarest are passed over (two sets of the limit or
more must share one), and a set is held to a linked group only until it joins it; so links are a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import partitions

#: Elements of the sets that are one part of a group.
BLOCK = 1_000_000
#: Elements of sets that are held to one set at once.
AT_ONCE = 1_000_000
#: What products of the limit may be off by.
OFF = 1e-9


def linked(values: np.ndarray, sizes: np.ndarray, similar: float) -> tuple[list[int], list[int]]:
    """Places of linked sets, a spanning forest of all pairs at `similar` or more. values has the sets one after another, each without repeats and not empty."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks = rank[which]
    sets = [np.sort(ranks[starts[i] : starts[i] + sizes[i]]) for i in order.tolist()]
    size = sizes[order]
    rarest = [s[:n] for s, n in zip(sets, (size - np.ceil(similar * size - OFF).astype(np.int64) + 1).tolist(), strict=True)]
    at = np.concatenate(rarest)
    owner = np.repeat(np.arange(len(sets)), [len(r) for r in rarest])[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(counts)))])
    label, marked = np.arange(len(sets)), np.zeros(len(counts), bool)
    found_a, found_b = [], []
    for y in range(1, len(sets)):
        r = rarest[y]
        seen = np.zeros(y, bool)
        for k in r[first[r + 1] - first[r] > 1].tolist():
            having = owner[first[k] : first[k + 1]]
            seen[having[: np.searchsorted(having, y)]] = True
        left = np.flatnonzero(seen)[::-1]  # those nearest in size first
        left = left[size[left] >= similar * size[y] - OFF]
        marked[sets[y]] = True
        step = 16
        while len(left):
            step = max(1, min(step, AT_ONCE // int(size[y])))
            some, left = left[:step], left[step:]
            both = np.add.reduceat(marked[np.concatenate([sets[x] for x in some.tolist()])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            hits = some[both >= similar * (size[some] + size[y] - both) - OFF].tolist()
            for x in hits:
                if label[x] != label[y]:
                    found_a.append(int(order[x]))
                    found_b.append(int(order[y]))
                    label[label == label[x]] = label[y]
            if hits:
                left = left[label[left] != label[y]]
            step *= 2
        marked[sets[y]] = False
    return found_a, found_b


def _groups(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (root, pair, node, elements) that come sorted by root and pair."""
    held: list[pa.RecordBatch] = []
    current = None

    def links() -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        node = rows["node"].to_numpy()
        if len(node) < 2:
            return node[:0], node[:0]
        elements = rows["elements"].combine_chunks()
        a, b = linked(elements.flatten().to_numpy(), pc.list_value_length(elements).to_numpy().astype(np.int64), similar)
        return node[a], node[b]

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

    for batch in batches:
        found = []
        root, pair = (batch.column(c).to_numpy() for c in ("root", "pair"))
        edges = [0, *(np.flatnonzero((root[1:] != root[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(root)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if current != (root[a], pair[a]) and held:
                found.append(links())
                held.clear()
            current = (root[a], pair[a])
            held.append(batch.slice(a, b - a))
        if found:
            yield batch_of(found)
    if held:
        yield batch_of([links()])


def overlaps(sets: DataFrame, similar: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes of sets(root, node, elements) of one root: what all pairs at `similar` or more join, they join. Empty sets have no links."""
    some = sets.where(F.size("elements") > 0)
    parts = some.groupBy("root").agg(F.ceil(F.sum(F.size("elements").cast("long")) / block).alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: (p != mine) | (F.col("parts") == 1))
    pairs = F.transform(others, lambda p: F.least(p, mine) * F.col("parts") + F.greatest(p, mine))
    dealt = some.join(parts, "root").select("root", F.explode(pairs).alias("pair"), "node", "elements")
    dealt = dealt.repartition(partitions(sets), "root", "pair").sortWithinPartitions("root", "pair")
    return dealt.mapInArrow(lambda batches: _groups(batches, similar), "a long, b long")
