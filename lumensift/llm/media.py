"""Media columns: texts carried losslessly as WAV audio, with acoustic fingerprints.

The payload (UTF-8 bytes, then spaces up to a positive multiple of 192) becomes the 8-bit mono samples of a WAV file,
which the wave module writes and reads back. Features: a short-time Fourier transform of the samples, its spectral
peaks, and pairs of near peaks hashed to fingerprints, stored as arrays coded by time.

Null text: empty, so 192 spaces: silence but for its level, and no pairs. Rows are independent, so null doc_ids, ties and repeated rows need no rule;
equal texts have equal values. Very long texts are transformed in parts. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumensift.llm.common import map_blocks, texts

UNIT, RATE = 192, 8000
#: Samples of a frame and between frames (so that the shortest payload has several); peaks of a frame; frames that a pair may span; frames transformed together.
FRAME, HOP, PEAKS, SPAN, CHUNK = 64, 32, 2, 2, 8192
#: Magnitudes are counted in quarters, so that rounding in a transform decides nothing; those below that of a tone of half a sample step are silence.
QUARTERS, SILENCE = 4, 4 * FRAME // 8

def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)


def peaks(samples: bytes) -> np.ndarray:
    """Rows (frames) of the PEAKS strongest local maxima (bins) of the magnitude spectrum, strongest first; ties: the lower bin. 0 where there is none."""
    signal = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    out = np.zeros((len(frames), PEAKS), np.int64)
    for a in range(0, len(frames), CHUNK):
        power = np.rint(np.abs(np.fft.rfft(frames[a : a + CHUNK] * _HANN, axis=1)) * QUARTERS).astype(np.int32)
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner >= SILENCE), inner, 0)
        for p in range(PEAKS):
            best = inner.argmax(axis=1)
            at = np.arange(len(best))
            out[a : a + CHUNK, p] = np.where(inner[at, best] > 0, best + 1, 0)
            inner[at, best] = 0
    return out


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, time) of each pair of a frame's peaks with those of the next SPAN frames, by time: the two bins (8 bits each) and the distance
    in time. Silent frames have none."""
    bins = peaks(samples)
    hashes, times = [], []
    for gap in range(1, SPAN + 1):
        a, b = bins[:-gap], bins[gap:]
        for i in range(PEAKS):
            for j in range(PEAKS):
                found = np.flatnonzero((a[:, i] > 0) & (b[:, j] > 0))
                hashes.append(a[found, i] << 16 | b[found, j] << 8 | gap)
                times.append(found)
    hashes, times = np.concatenate(hashes), np.concatenate(times)
    order = np.argsort(times, kind="stable")
    return hashes[order].astype("<u4"), times[order].astype("<u4")


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text, ...): sizes and checksums of the payload read back and of the stored form, the feature string
    frames:pairs:CRC-32 of the hashes:CRC-32 of their times, and the arrays `hashes` and `times` themselves. with_media: the WAV file as well."""

    def work(block: pa.RecordBatch, strings: list[str]) -> pa.RecordBatch:
        rows, arrays = [], []
        for text in strings:
            media = to_wav(payload(text))
            samples = from_wav(media)
            hashes, times = fingerprints(samples)
            feature = f"{(len(samples) - FRAME) // HOP + 1}:{len(hashes)}:{zlib.crc32(hashes):08x}:{zlib.crc32(times):08x}"
            row = (len(text.encode("utf-8", "surrogatepass")), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            rows.append((*row, media) if with_media else row)
            arrays.append((hashes, times))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=False)]
        offsets = np.concatenate([[0], np.cumsum([len(h) for h, _ in arrays])]).astype(np.int32)
        coded = [pa.ListArray.from_arrays(offsets, np.concatenate(a).astype(np.int32)) for a in zip(*arrays, strict=True)]
        return pa.RecordBatch.from_arrays([block.column(0), *columns[:7], *coded, *columns[7:]], _NAMES[: 10 + with_media])

    return map_blocks(texts(docs), ", ".join(f"{n} {t}" for n, t in zip(_NAMES[: 10 + with_media], _SQL, strict=False)), work)


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hashes", "times", "media"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
_SQL = ["long", "long", "long", "string", "long", "long", "string", "string", "array<int>", "array<int>", "binary"]
