"""Words, shingles and n-gram hashes of whole Arrow text columns in NumPy.

Texts are read as UTF-8 bytes. Separators of all word rules here are ASCII, so a byte
table finds words without decoding. Work goes in chunks of documents of about
``CHUNK_BYTES``; one longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _byte_table(members: range | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: words are runs of anything but space, tab, line ends, vertical tab and form feed
NOT_SPACE = ~_byte_table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, grown when needed."""
    global _powers, _inverses
    if len(_powers) < size:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))), dtype=np.uint64)
            _inverses = np.cumprod(
                np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE_INVERSE))), dtype=np.uint64
            )
    return _powers, _inverses


@dataclass
class Chunk:
    """Bytes of some neighbouring rows; ``bounds`` has one more entry than rows."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Lower-cased (A-Z only) bytes of a text column. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kinds = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, kinds)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        low, high = offsets[row], offsets[end]
        yield Chunk(row, LOWER[raw[low:high]], offsets[row : end + 1] - low)
        row = end


def word_spans(chunk: Chunk, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row of every word; no word crosses a row."""
    inside = member[chunk.data]
    size = len(inside)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, none
    edges = chunk.bounds[(chunk.bounds > 0) & (chunk.bounds < size)]
    before = np.concatenate(([False], inside[:-1]))
    before[edges] = False
    after = np.concatenate((inside[1:], [False]))
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(chunk.bounds, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order of their starts.

    A polynomial over the bytes from prefix sums, then a finaliser. Blocks of spans
    bound the memory for one very long text.
    """
    found = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            stop = max(int(np.searchsorted(ends, low + CHUNK_BYTES, "right")), at + 1)
            high = int(ends[at:stop].max())
            powers, inverses = _tables(int(high - low) + 1)
            terms = (data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            a, b = starts[at:stop] - low, ends[at:stop] - low
            found[at:stop] = mix((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64) * _BASE)
            at = stop
    return found


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` neighbours inside one row."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    same = rows[:count] == rows[size - 1 :]
    with np.errstate(over="ignore"):
        total = np.zeros(count, np.uint64)
        for k in range(size):
            total = (total + hashes[k : k + count]) * _BASE
        return mix(total[same] + np.uint64(size)), rows[:count][same]


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted inside it, and the row bounds.

    A row with fewer words than ``size`` has its whole word sequence as one shingle;
    a row without words has none.
    """
    starts, ends, rows = word_spans(chunk)
    hashes = span_hashes(chunk.data, starts, ends)
    grams, owner = gram_hashes(hashes, rows, size)
    counts = np.bincount(rows, minlength=chunk.rows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        whole = np.array(
            [_sequence(hashes[f : f + counts[r]]) for f, r in zip(first, short)], np.uint64
        )
        owner = np.concatenate((owner, short))
        grams = np.concatenate((grams, whole))
        order = np.argsort(owner, kind="stable")
        owner, grams = owner[order], grams[order]
    bounds = np.searchsorted(owner, np.arange(chunk.rows + 1))
    for low, high in zip(bounds[:-1], bounds[1:]):
        grams[low:high].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    kept = owner[fresh]
    return grams[fresh], np.searchsorted(kept, np.arange(chunk.rows + 1))


def _sequence(hashes: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        total = np.uint64(0)
        for h in hashes:
            total = (total + h) * _BASE
        return mix(total + np.uint64(len(hashes)))
