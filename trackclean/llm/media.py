"""Media columns: texts' bytes as WAV files, read back by the wave module, with spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import balanced

UNIT = 64
RATE = 8000
#: Short-time Fourier transform: samples in a frame and from one frame to the next.
FRAME = 256
HOP = 128
#: A frame's peaks are its strongest bins that are stronger than both neighbours; each is paired with the strongest peak of
#: each of the next FAN frames.
PEAKS = 2
FAN = 3
#: Frames transformed at once, whatever the length of the media.
CHUNK_FRAMES = 4096


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


def write_wav(payload: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """The PEAKS strongest local maxima of each frame's spectrum (a row for each frame; strongest first, ties by lower bin;
    0 where a frame has fewer).

    Samples are centred and padded with silence to whole frames; frames overlap by FRAME - HOP. Of a plateau its first bin
    counts. Strengths are rounded to two places, which settles most ties; peaks closer than that may differ between machines.
    """
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    x = np.zeros((n - 1) * HOP + FRAME, np.float32)
    x[: len(samples)] = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    found = []
    for at in range(0, n, CHUNK_FRAMES):
        power = np.abs(np.fft.rfft(frames[at : at + CHUNK_FRAMES] * _WINDOW, axis=1)).round(2)
        inner = power[:, 1:-1]
        strength = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = []
        for _ in range(PEAKS):
            k = strength.argmax(axis=1)
            rows = np.arange(len(k))
            best.append(np.where(strength[rows, k] > 0, k + 1, 0))
            strength[rows, k] = 0
        found.append(np.stack(best, axis=1))
    return np.concatenate(found).astype(np.int64)


def pair_fingerprint(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): each frame's peaks paired with the first peak of the next FAN frames, ordered by time, then code.

    A code is anchor bin, target bin and frames between, 8 bits each; its time is the anchor's frame. A sound without any
    pair has one code, its first peak alone.
    """
    n = len(peaks)
    times, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, min(FAN, n - 1) + 1):
        a, b = peaks[: n - step], peaks[step:, :1]
        there = (a > 0) & (b > 0)
        codes.append(((a << 16) | (b << 8) | step)[there])
        times.append(np.repeat(np.arange(n - step), peaks.shape[1]).reshape(a.shape)[there])
    t, c = np.concatenate(times), np.concatenate(codes)
    if not len(c):
        return np.zeros(1, np.int64), peaks[:1, 0] << 16
    order = np.lexsort((c, t))
    return t[order], c[order]


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, the text's size, the stored media and what is read back from it, the fingerprint as time-coded array.

    Each row: n_bytes, media (the WAV file), payload (read back from it), pairs (array of time << 24 | code). Null and
    empty texts are UNIT zero bytes; equal texts give equal values; other columns are ignored.
    """
    return _media(docs, whole=True)


def media_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_pairs.

    The digests of media_columns: hashes of the payload read back and of the WAV file, and of the fingerprint array
    (feature: the SHA-256 of its little-endian 64-bit values).
    """
    return _media(docs, whole=False)


def _media(docs: DataFrame, whole: bool) -> DataFrame:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64()}
    if whole:
        kinds |= {"media": pa.binary(), "payload": pa.binary(), "pairs": pa.list_(pa.int64())}
        schema = "doc_id long, n_bytes long, media binary, payload binary, pairs array<long>"
    else:
        kinds |= {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n_pairs": pa.int64()}
        schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long"

    def row(doc: int, text: bytes) -> tuple:
        media = write_wav(payload_of(text))
        payload = read_wav(media)
        times, codes = pair_fingerprint(spectral_peaks(np.frombuffer(payload, np.uint8)))
        pairs = (times << 24 | codes).astype("<i8")
        if whole:
            return doc, len(text), media, payload, pairs
        return doc, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(pairs.tobytes()).hexdigest(), len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text"):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                rows = [row(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(run, schema)
