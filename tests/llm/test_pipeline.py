"""The pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from lumensift.llm import secrets, simhash
from lumensift.llm.common import written
from lumensift.llm.overlap import overlaps
from tests.llm.test_operators import plain_repeats


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_near_groups(rows):
    """The doc_ids that stay and those that go if texts whose five-word shingles have a Jaccard similarity of 0.8 or more are joined. Pairs are
    sought by shingles of 300 texts at most, so some are missed."""
    sets = [plain_shingles(t) for _, t in rows]
    having = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            having[x].append(n)
    common = Counter()
    for found in having.values():
        if len(found) <= 300:
            common.update(combinations(found, 2))
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    same = defaultdict(list)
    for n, (_, t) in enumerate(rows):
        same[t].append(n)
    links = [(n[0], x) for n in same.values() for x in n[1:]] + [(a, b) for (a, b), k in common.items() if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k)]
    for a, b in links:
        a, b = sorted((find(a), find(b)), key=lambda n: rows[n][0])
        root[b] = a
    stays = {rows[n][0] for n in range(len(rows)) if find(n) == n}
    return stays, {i for i, _ in rows} - stays


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_recall_of_near_duplicates(spark, folder):
    """Nine in ten of the documents that have an earlier near copy go, and no others."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").where("n_chars > 0")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    stays, goes = plain_near_groups([*rows.items()])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    left = goes & kept
    assert len(left) <= 0.1 * len(goes)
    sets = {i: plain_shingles(t) for i, t in rows.items()} if stays - kept else {}
    for i in stays - kept:  # those that the plain search missed
        assert any(j < i and len(s & sets[i]) >= 0.8 * len(s | sets[i]) for j, s in sets.items())


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{n}" for n in range(60))
    rows = [(5, text), (3, text), (None, text), (None, None), (None, ""), (2, ""), (9, text.replace("w7 ", "x ")), (4, "one two"), (4, "one  two"), (4, text), (8, "  "), (7, "a b c"), (7, "a b c")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, stays int, `a.b` int, `c d``e` int")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(3, text), (2, ""), (4, "one two"), (4, "one  two"), (8, "  "), (7, "a b c"), (7, "a b c")])
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with a word changed here and there are one group, of which the first stays."""
    rng = random.Random(4)
    words = [f"word{n}" for n in range(200)]
    rows = [(0, " ".join(words))]
    for n in range(1, 1500):
        copy = [*words]
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(200)] = f"changed{n}"
        rows.append((n, " ".join(copy)))
    kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == alone(rows)


def test_sets_take_one_worker_a_task(spark, monkeypatch):
    """No stage that makes shingle sets has a second Python operator, whose workers would hold memory of their own."""
    plans = []
    monkeypatch.setattr(simhash, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df))[1])
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words alone")], "doc_id long, text string")
    assert simhash.similar_links(docs).count() == 1
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 1 and "EvalPython" not in plans[0]


def alone(rows):
    """The doc_ids that stay if all pairs are looked at."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if root[a] != root[b]:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
    return {rows[r][0] for r in root}


@pytest.mark.parametrize("block", [10**6, 700])
def test_overlaps_in_parts(spark, block):
    """Sets that lie near the limit, in groups that are one part or many, against all pairs."""
    rng = random.Random(8)
    rows = []
    for group in range(4):
        base = [rng.randrange(1 << 40) for _ in range(40)]
        for n in range(60):
            kept = set(rng.sample(base, rng.randint(30, 40))) | {rng.randrange(1 << 40) for _ in range(rng.randint(0, 4))}
            rows.append((group, len(rows), sorted(kept)))
    rows += [(9, 1000, []), (9, 1001, []), (10, 1002, [7])]
    frame = spark.createDataFrame(rows, "root long, node long, elements array<long>")
    links = [(r["a"], r["b"]) for r in overlaps(frame, 0.8, block).collect()]
    sets = {n: set(e) for _, n, e in rows}
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert all(similar(a, b) for a, b in links)

    def joined(pairs):
        root = {n: n for n in sets}
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
        return root

    ids = [(g, n) for g, n, e in rows if e]
    assert joined(links) == joined((a, b) for g, a in ids for h, b in ids if g == h and a < b and similar(a, b))



def test_least_links():
    rng = random.Random(3)
    for _ in range(50):
        links = [(rng.randrange(30) * 7 - 100, rng.randrange(30) * 7 - 100) for _ in range(rng.randint(0, 30))]
        root = {n: n for link in links for n in link}
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
        a, b = simhash.least_links(*(np.array([x[k] for x in links], np.int64) for k in (0, 1)))
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {n: r for n, r in root.items() if n != r}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept.append(sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()))
    rules, near, repeats, clean = kept
    stays, goes = plain_near_groups([(i, t) for i, t, _ in rules])
    assert stays <= {i for i, _, _ in near} and sum(i in {i for i, _, _ in near} for i in goes) <= 0.1 * len(goes)
    cut = {i: n for i, _, n, _, _ in plain_repeats([(i, t) for i, t, _ in near])}
    before = {i: t for i, t, _ in near}
    assert all(len(before[i].encode()) - cut[i] >= len(t.encode()) and (cut[i] or t == before[i]) for i, t, _ in repeats)
    vocabulary = secrets.default_vocabulary()
    assert all(not secrets.spans(t.replace("[secret]", " "), vocabulary) and n == len(t) for _, t, n in clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    whole = Counter()
    for p in pieces:
        whole[p["doc_id"]] += p["length"]
    assert whole == Counter({p["doc_id"]: p["doc_tokens"] for p in pieces}) and set(whole) == {i for i, _, _ in clean}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
