"""Whole Arrow columns of text as numpy byte arrays: words, their hashes, and blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text with A-Z in lower case (UTF-8).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words ``[^\x20\x09-\x0D]+``.
GRAPHIC = np.ones(256, dtype=bool)
GRAPHIC[9:14] = GRAPHIC[32] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices whose texts hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(size)
    if len(sizes) > first:
        yield batch.slice(first)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), step, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are ascending, apart and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    edges = np.zeros(len(starts), np.int64)
    np.cumsum(sizes[:-1], out=edges[1:])
    total = int(edges[-1] + sizes[-1])
    within = np.arange(total, dtype=np.int64)
    within -= np.repeat(edges, sizes)
    if total == len(data):
        own = data
    else:
        own = data[within + np.repeat(starts, sizes)]
    return mixed(np.add.reduceat(_BYTE[own] * powers(int(sizes.max()))[within], edges) + sizes.astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_byte[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a block of texts: ``hashes``, the spans, and ``bounds[i]:bounds[i+1]`` for text i."""

    def __init__(self, column: pa.Array, word_byte: np.ndarray = ALNUM):
        raw, self.offsets = utf8(column)
        self.data = LOWER[raw]
        self.starts, self.ends = word_spans(self.data, self.offsets, word_byte)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """The text that holds each of these word numbers."""
        return np.searchsorted(self.bounds, word, side="right") - 1
