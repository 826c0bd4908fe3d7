"""Whole texts as bytes inside a task: words, their fingerprints, and slices of Arrow batches bounded by bytes.

A word fingerprint mixes the word's bytes eight at a time through bijections, so words of up to eight bytes of one
length never collide and longer ones do with probability about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but blanks: [^\x20\x09-\x0D].
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Letters and digits of ASCII in lower case, and every byte of a longer character: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One fingerprint of two, in this order."""
    return mix(left * _C + mix(right))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about `limit` bytes of text; a longer text comes alone."""
    sizes = batch.column(column).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def released(step: Callable) -> Callable:
    """A task function that gives freed memory back to the system when its task ends: workers are used again, and idle ones would keep their peak."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def unpacked(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """First row, end and texts of row ranges of a column of compressed texts, in about `limit` bytes of text; a longer text comes alone."""
    unpack, first, texts, size = zstandard.ZstdDecompressor(), 0, [], 0
    for i in range(len(column)):
        packed = column[i].as_py()
        text = None if packed is None else unpack.decompress(packed)
        if texts and size + len(text or b"") > limit:
            yield first, i, texts
            first, texts, size = i, [], 0
        texts.append(None if text is None else text.decode("utf-8", "surrogatepass"))
        size += len(text or b"")
    if texts:
        yield first, len(column), texts


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the offset of each text; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(low: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes of the class `inside`; runs end with their text."""
    if not low.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    of = inside[low]
    before, after = np.zeros_like(of), np.zeros_like(of)
    before[1:], after[:-1] = of[:-1], of[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(of & ~before)
    return starts, np.flatnonzero(of & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def fingerprints(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte range."""
    padded = np.zeros(low.size + 16, np.uint8)
    padded[: low.size] = low
    eight = np.ndarray((low.size + 8,), "<u8", buffer=padded, strides=(1,))
    length = ends - starts
    out = mix((eight[starts] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _C)
    far, at = np.flatnonzero(length > 8), 8
    while far.size:
        left = length[far] - at
        out[far] = pair(out[far], eight[starts[far] + at] & _MASK[np.minimum(left, 8)])
        far, at = far[left > 8], at + 8
    return out


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Of sorted text numbers, where each of n texts begins, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))
