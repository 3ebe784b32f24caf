"""Words and word shingles of a batch of texts as arrays: helpers for Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_RANDOM = np.random.default_rng(20240229)
#: A random number for each byte value, and odd multipliers for places in a shingle.
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEED = 20240229
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[int(base)] = found = np.multiply.accumulate(x)
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one after another, and each text's first byte (one offset more than texts)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of each word; words end with their text."""
    word = ~SPACE[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    edge = inner[(inner > 0) & (inner < len(buf))]
    start[edge] |= word[edge]
    end[edge - 1] |= word[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, as bytes, and each word's number among them: words are told apart by all their bytes."""
    size = ends - starts
    total = int(size.sum())
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    data = buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] if total < len(buf) else buf
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, half: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: one half (0 or 1) of the 128-bit XXH3 hash of its bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    words, nth = distinct_words(buf, starts, ends)
    digests = b"".join([xxh3_128_digest(w, SEED) for w in words.to_pylist()])
    return np.frombuffer(digests, np.uint64)[half::2][nth]


def shingle_sets(column: pa.Array, width: int = 5, half: int = 0) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of width lower-cased words; with fewer words, one for them all; else none.

    The two halves are of independent hashes: what is found by one can be confirmed by the other.
    """
    buf, offsets = raw(column)
    buf = LOWER[buf]
    starts, ends, text = word_spans(buf, offsets)
    hashes = word_hashes(buf, starts, ends, half)
    first = np.searchsorted(text, np.arange(len(offsets)))
    n = len(hashes)
    whole = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        whole[: n - k] += hashes[k:] * PLACE[k]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out
