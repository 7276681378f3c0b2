"""Vectorised text primitives over Arrow batches: whole texts as UTF-8 bytes, words, shingles.

A batch of texts is one byte array plus offsets.  Words are runs of bytes outside
``[\\x20\\x09-\\x0D]``; all separators are ASCII, so bytes and code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step handles; one longer document is a step of its own.
STEP_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240611)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
MIX = [U64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give memory that this worker has freed back, as it may serve other stages for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another allocator
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that ends with ``release``."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * MIX[0]
    x = (x ^ (x >> U64(27))) * MIX[1]
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        for name, b in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(n + 1, b, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document number of every word."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * MIX[4])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 4) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A document of fewer words has one shingle, its whole word sequence; one without words none.
    """
    out: list[np.ndarray] = []
    for i, j in steps(offsets):
        part, offs = LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, doc = word_spans(part, offs)
        h = word_hashes(part, starts, ends)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        if len(h) >= width:
            s = h[: len(h) - width + 1] * MIX[0]
            for k in range(1, width):
                s = mix64(s) + h[k : len(h) - width + 1 + k] * MIX[k % 5]
            s = mix64(s)
        for d in range(j - i):
            a, b = int(at[d]), int(at[d + 1])
            if b - a >= width:
                out.append(np.unique(s[a : b - width + 1]))
            elif b > a:
                x = np.array([b - a], U64)
                for k in range(a, b):
                    x = mix64(x) + h[k : k + 1] * MIX[2]
                out.append(mix64(x))
            else:
                out.append(np.zeros(0, U64))
    return out
