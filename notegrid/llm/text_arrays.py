"""Texts of an Arrow column as bytes, and 64-bit hashes of their words, computed with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def texts(column: pa.Array | pa.ChunkedArray):
    """The bytes of each text as a uint8 array without copying; null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        wide = pa.types.is_large_string(chunk.type)
        _, ends, data = chunk.buffers()
        at = np.frombuffer(ends, np.int64 if wide else np.int32, len(chunk) + 1 + chunk.offset)[chunk.offset:]
        body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        valid = np.asarray(chunk.is_valid())
        for i in range(len(chunk)):
            yield body[at[i]:at[i + 1]] if valid[i] else body[:0]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT)
        for k, base in enumerate((BASE, INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def _segment_words(text: np.ndarray) -> np.ndarray:
    gap = SPACE[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(text))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:len(text)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A hash per word of lower-cased (A-Z) ``text``; long texts are worked off in pieces cut at spaces."""
    text = LOWER[text]
    if len(text) <= SEGMENT:
        return _segment_words(text)
    parts, at = [], 0
    while at < len(text):
        end = min(at + SEGMENT, len(text))
        if end < len(text):
            gaps = np.flatnonzero(SPACE[text[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(SPACE[text[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(text)
        parts.append(_segment_words(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``n``-word shingles; a text of fewer words is its own shingle."""
    k = min(n, len(words))
    if not k:
        return words
    last = len(words) - k + 1
    h = words[:last]
    for j in range(1, k):
        h = mix(h * np.uint64(3) + mix(words[j:last + j] ^ np.uint64(0xA0761D6478BD642F)))
    return np.unique(h if k == n else mix(h + np.uint64(0x51ED270B)))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of two-word shingles; one word alone is its own shingle."""
    return shingle_hashes(words, 2)
