"""Hashed features of whole text columns in NumPy, for the linear models."""

from __future__ import annotations

import numpy as np

from fathomline.llm.words import Chunk, _byte_table, gram_hashes, mix, span_hashes, word_spans

#: letters: a-z and every byte of a multi-byte character
LETTER = _byte_table([*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)])
#: sentences end at these bytes
STOP = _byte_table([ord(c) for c in ".!?\n"])


def distinct_per_row(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row and the row bounds; ``values`` are below 2^32."""
    key = (owner.astype(np.uint64) << np.uint64(32)) | values.astype(np.uint64)
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    bounds = np.searchsorted(key >> np.uint64(32), np.arange(rows + 1, dtype=np.uint64))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), bounds


def byte_grams(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` bytes inside one row."""
    count = len(chunk.data) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(count, np.uint64)
    for k in range(size):
        packed = (packed << np.uint64(8)) | chunk.data[k : k + count]
    owner = np.repeat(np.arange(chunk.rows), np.diff(chunk.bounds))
    same = owner[:count] == owner[size - 1 :]
    return mix(packed[same] + (np.uint64(size) << np.uint64(60))), owner[:count][same]


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def prefix_hashes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word, apart from whole words."""
    return mix(span_hashes(chunk.data, starts, np.minimum(ends, starts + size)) ^ np.uint64(size))


def sentence_ids(chunk: Chunk, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its sentence in the chunk, and each sentence's row.

    Only sentences with words count.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = np.flatnonzero(STOP[chunk.data])
    piece = np.searchsorted(stops, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])
    return np.cumsum(new) - 1, rows[new]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``; empty segments give zero."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


__all__ = [
    "LETTER",
    "bucket",
    "byte_grams",
    "distinct_per_row",
    "gram_hashes",
    "prefix_hashes",
    "segment_sums",
    "sentence_ids",
    "span_hashes",
    "word_spans",
]
