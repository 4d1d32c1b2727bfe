"""Secret scans: fixed patterns, and strings that a tokenizer cannot compress.

Token-efficiency test: a candidate string whose characters-per-token ratio under a tiktoken vocabulary is low looks
random. Excluded are known digests (hexadecimal strings of a digest's length), UUIDs and identifiers (words joined by
underscores or hyphens, paths, names in camel case), these as long as the words themselves are no random letters. Spans of the fixed patterns always stay; of a
candidate that they cover in part, the rest is tested too.

Spans are [start, end) in code points. Null text: empty, no spans. Rows are independent, so repeated rows, ties and null
doc_ids need no rule. Very long texts: a block of their own. Empty table: no rows. Other columns are not read by scanned(), and kept by redacted(), whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import map_blocks, quoted, texts

#: The kinds in their order, and the patterns of the first three with the least length.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A text without any of these has no match of ASSIGN.
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
#: Candidates of the token-efficiency test, and their least length.
SHORTEST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words in camel case, with a short number behind. An identifier joins such parts, or is one of several words; a single word is left to the ratio.
_PART = r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[A-Z][a-z]{2,}|(?<=[a-z])[A-Z]{2,})*[0-9]{0,4}"
IDENTIFIER = re.compile(rf"(?:{_PART}|[0-9]{{1,4}})(?:[-_/](?:{_PART}|[0-9]{{1,4}}))+|(?:[A-Z]?[a-z]{{2,}}|[A-Z]{{2,}})(?:[A-Z][a-z]{{2,}}|(?<=[a-z])[A-Z]{{2,}})+[0-9]{{0,4}}")
#: The words and numbers of an identifier.
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Characters per token below which a candidate counts as random.
RATIO = 2.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found)


def _ratio(strings: list[str], path: str) -> float:
    """Characters per token of some strings, each by itself."""
    return sum(map(len, strings)) / sum(map(len, encoding(path).encode_ordinary_batch(strings, num_threads=1)))


def looks_random(candidate: str, path: str, ratio: float = RATIO) -> bool:
    """Whether a string is none of the known digests, no UUID, no identifier whose own words a tokenizer compresses, and has few characters per token."""
    if len(candidate) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-fA-F]+", candidate) or UUID.fullmatch(candidate):
        return False
    if IDENTIFIER.fullmatch(candidate) and _ratio(WORDS.findall(candidate), path) >= ratio:
        return False
    return _ratio([candidate], path) < ratio


def random_spans(text: str, base: list[tuple[int, int, int]], path: str, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that look random. Where fixed patterns have a part of one, the whole is taken if it looks random, else each of the parts that they leave
    of it which is long enough for a candidate and looks random; where they have all of it, none."""
    out = []
    for m in CANDIDATE.finditer(text):
        inside = [(max(s, m.start()), min(e, m.end())) for s, _, e in base if s < m.end() and m.start() < e]
        if not inside:
            if looks_random(m[0], path, ratio):
                out.append((m.start(), 3, m.end()))
            continue
        gaps, at = [], m.start()
        for s, e in [*inside, (m.end(), m.end())]:
            if s > at:
                gaps.append((at, s))
            at = max(at, e)
        if gaps and looks_random(m[0], path, ratio):
            out.append((m.start(), 3, m.end()))
        else:
            out += [(s, 3, e) for s, e in gaps if e - s >= SHORTEST and looks_random(text[s:e], path, ratio)]
    return out


def spans(text: str, path: str, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans."""
    base = base_spans(text)
    return sorted(base + random_spans(text, base, path, ratio))


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scanned(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans for each row of docs(doc_id, text, ...)."""
    path = vocabulary or default_vocabulary()

    def work(block: pa.RecordBatch, strings: list[str]) -> pa.RecordBatch:
        found = [spans(t, path, ratio) for t in strings]
        counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(4)]
        digest = [hashlib.sha256(told([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
        return pa.RecordBatch.from_arrays([block.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(told, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return map_blocks(texts(docs), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", work)


def redacted(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO, mask: str = "[secret]") -> DataFrame:
    """docs, each span of its texts (overlapping ones as one) replaced by `mask`, and n_chars, if there, recounted. A null text stays null."""
    path = vocabulary or default_vocabulary()

    def clean(text: str) -> str:
        out, at = [], 0
        for s, _, e in spans(text, path, ratio):
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([None if t is None else clean(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["more", "text"])

    rows = docs.select(F.struct(*(docs[quoted(c)] for c in docs.columns if c != "text")).alias("more"), docs["text"].cast("string").alias("text"))
    out = rows.mapInArrow(run, rows.schema)
    recounted = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*(F.col("text") if c == "text" else recounted.alias(c) if c == "n_chars" else F.col("more")[c].alias(c) for c in docs.columns))
