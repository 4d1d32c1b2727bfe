"""Alignment of two tokenizers against the libraries, text by text."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from lumensift.llm import token_alignment
from lumensift.llm.token_alignment import Aligner
from lumensift.llm.token_counts import default_tokenizer
from lumensift.llm.piece_dropout import default_model

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_model())


def byte_of_letter():
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def groups_of(text, a, b, letters):
    """Groups of a text: pairs of lists of ids."""
    if not text:
        return []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
    if not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()):
        return []
    ends = []
    for raw in (a_bytes, b_bytes):
        at, own = 0, []
        for r in raw:
            at += len(r)
            own.append(at)
        ends.append(own)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = ([], [])
        while i < len(a_ids) and ends[0][i] <= cut:
            group[0].append(a_ids[i])
            i += 1
        while j < len(b_ids) and ends[1][j] <= cut:
            group[1].append(b_ids[j])
            j += 1
        groups.append(group)
    return groups


def plain(pairs):
    a, b = libraries()
    letters = byte_of_letter()
    all_groups = [groups_of(t, a, b, letters) for _, t in pairs]
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in all_groups]
    documents = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    for (i, _), groups, own in zip(pairs, all_groups, links, strict=True):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (
            i,
            sum(len(g[0]) for g in groups),
            sum(len(g[1]) for g in groups),
            len(groups),
            sum(own.values()),
            sum(n for p, n in own.items() if documents[p] == most[p[0]]),
            sum(n * documents[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


def same(df, rows):
    assert df.columns == COLUMNS
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))


ODD = [
    (100, " leading  and   many \n\n lines\n \t tabs\r\n\rreturns;\r );\r"),
    (101, "a  b c 　d  e\x1c f!\x1cg \x85h i  "),
    (102, "   "),
    (103, "\n"),
    (104, "x"),
    (105, "trailing "),
    (106, "don't we'll 'S it's 'ſ <|endoftext|> <s> </s> <unk> <0x41>"),
    (107, "a▁b and ▁"),
    (108, "日本語の文章 中文句子 한국어 \U0001f600\U0001f601 é ﻿ ​ ½ﬁ"),
    (109, "\x00\x01 \x7f"),
    (110, "тест слова the\nthe the\n the"),
    (111, "1234567 12 345 3.14159 1,000,000 x=1;y=2"),
]


def test_alignments(spark, edge, pairs):
    same(token_alignment.alignments(edge), plain(pairs))


def test_odd_texts(spark):
    same(token_alignment.alignments(spark.createDataFrame(ODD, "doc_id long, text string").repartition(2)), plain(ODD))


def test_empty(edge):
    assert token_alignment.alignments(edge.limit(0)).collect() == []


def test_small_blocks(monkeypatch):
    """Many blocks, segments a few at a time, and groups whose links are counted and not written out."""
    rng = random.Random(5)
    marks = [" ", "  ", "\n", " \n", "\t", " ", "\r", "　", ""]
    words = ["the", "Thonblewh", "naïve", "日本", "don't", "12", "!!", "▁", "aaaa", "été", "\U0001f600"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    want = list(plain(rows))
    for name, value in (("BLOCK", 700), ("SPLIT", 300), ("TOGETHER", 7), ("COMPOSED", 20), ("GROUP_LINKS", 2)):
        monkeypatch.setattr(token_alignment, name, value)
    # the workers import the module anew, so the functions that they run are called here
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    parts = pa.Table.from_batches(token_alignment._blocks([batch], default_tokenizer(), default_model()))
    assert len(set(parts["block"].to_pylist())) > 5
    segments = parts.filter(pa.compute.is_null(parts["packed"])).select(["block", "place", "segment"]).sort_by("segment")
    groups = pa.Table.from_batches(token_alignment._align(segments.to_batches(max_chunksize=5), default_tokenizer(), default_model()))
    composed = []
    for block in sorted(set(parts["block"].to_pylist())):
        own = pa.compute.equal(parts["block"], block)
        left = parts.filter(pa.compute.and_(own, pa.compute.is_valid(parts["packed"])))
        composed.append(token_alignment._compose((pa.scalar(block),), left, groups.filter(pa.compute.equal(groups["block"], block))))
    links = pa.concat_tables([t.filter(pa.compute.is_valid(t["pair"])) for t in composed])
    total = Counter()
    for p, n in zip(links["pair"].to_pylist(), links["n"].to_pylist(), strict=True):
        total[p] += n
    most = defaultdict(int)
    for p, n in total.items():
        most[p >> 32] = max(most[p >> 32], n)
    got = []
    for t in composed:
        own = t.filter(pa.compute.is_valid(t["pair"]))
        known = pa.table({"number": own["number"], "total": [total[p] for p in own["pair"].to_pylist()], "best": [total[p] == most[p >> 32] for p in own["pair"].to_pylist()]}, schema=pa.schema([("number", pa.int32()), ("total", pa.int64()), ("best", pa.bool_())]))
        got += token_alignment._total((), t.filter(pa.compute.is_valid(t["packed"])), known).to_pylist()
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in got) == sorted(map(repr, want))


def test_cuts():
    """Cuts keep the tokens of both libraries, and where a piece has white space after another character there is none."""
    aligner = Aligner(default_tokenizer(), default_model())
    assert " " in aligner.cut_marks() and "\n" in aligner.cut_marks()
    a, b = libraries()
    assert "\r" not in aligner.cut_marks() and any(";\r" in b.id_to_piece(i) for i in range(b.get_piece_size()))
    for _, text in ODD:
        segments = aligner.split(" " + text)
        assert "".join(segments) == " " + text
        assert [i for s in segments for i in a.encode(s, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("segment", ["x▁", "▁"])
def test_marks_have_no_tokens(segment):
    assert Aligner(default_tokenizer(), default_model()).aligned([" a", segment, " b"])[1] == ""
