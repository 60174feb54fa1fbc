"""Vectorised helpers over the UTF-8 bytes of many texts at once: words, word hashes, shingles, prefix hashes.

All arithmetic is modulo 2^64. A text is never cut: a chunk holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: For steps that hold some ten numbers of 64 bits for each byte of a chunk.
SMALL_CHUNK_BYTES = 1 << 19
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for k, b in enumerate((BASE, BASE_INVERSE)):
            grown = np.full(size, b, U)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of value(data[k]) * base^k over i <= k < j."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever those bytes stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, of about ``most`` bytes unless one text has more."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


#: White space and ASCII punctuation: what parts words where marks don't count.
MARKS = SPACE.copy()
MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the place of its first word (one more for the end)."""
    solid = ~gaps[data]
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    start[first] |= solid[first]
    stop[last] |= solid[last]
    begin = np.flatnonzero(start)
    return begin, np.flatnonzero(stop) + 1, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z taken as a-z, and the place of each text's first word."""
    begin, end, place = words(data, offsets, gaps)
    return mix(range_hash(prefix_hash(LOWER[data]), begin, end) + (end - begin).astype(U)), place


SHINGLE = 5
_FACTORS = mix(np.arange(11, 11 + SHINGLE, dtype=U)) | U(1)


def shingle_sets(hashes: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; a shorter text is one shingle."""
    n = len(hashes)
    full = np.zeros(max(n - SHINGLE + 1, 0), U)
    for k in range(SHINGLE):
        full += hashes[k : k + len(full)] * _FACTORS[k]
    full = mix(full)
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(full[a : b - SHINGLE + 1])
        elif b > a:
            short = np.array([(hashes[a:b] * _FACTORS[: b - a]).sum(dtype=U) + U(b - a)], U)
            yield mix(mix(short))
        else:
            yield np.zeros(0, U)
