"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 18
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text). Words are runs of anything but ASCII white space, with A-Z lower-cased."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).lower(), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in raw])
    word = ~_SPACE[data]
    start = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data, word = data[start[0] :], word[start[0] :]
    place = np.arange(len(data)) - np.repeat(start - start[0], np.diff(np.append(start - start[0], len(data))))
    value = _BYTE[data] * (_PLACE[place & 255] * (2 * (place >> 8).astype(np.uint64) + np.uint64(1)))
    value[~word] = 0
    return mix(np.add.reduceat(value, start - start[0])), np.searchsorted(ends, start, side="right")


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about CHUNK bytes of text with their texts, so that memory follows one slice and not a batch."""
    for batch in batches:
        texts = [x or "" for x in batch.column(column).to_pylist()]
        lo = size = 0
        for k, x in enumerate(texts):
            size += len(x)
            if size >= CHUNK or k == len(texts) - 1:
                yield batch.slice(lo, k + 1 - lo), texts[lo : k + 1]
                lo, size = k + 1, 0
