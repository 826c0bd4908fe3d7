"""Sampled suffixes of byte texts: the positions where the suffixes of a sparse suffix array begin.

Every string of `length` bytes holds length - GRAM + 1 grams of GRAM bytes; its anchor is the leftmost gram with the
least fingerprint. Equal strings have their anchor at the same place, so the strings of a text fall into runs of
neighbours with one anchor, and a string occurs elsewhere only if its anchor's suffix does.
"""

from __future__ import annotations

import numpy as np

from .text import mix

GRAM = 64

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + _RANDOM.integers(0, 2, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base, np.ones(1, np.uint64))
    while held.size < n:
        held = np.concatenate([held, held * np.uint64(pow(base, held.size, 1 << 64))])
    _POWERS[base] = held
    return held[:n]


class Prefixes:
    """Fingerprints of any byte ranges of one buffer, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, data.size), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """mix of the polynomial of each range."""
        return mix((self.sums[ends] - self.sums[starts]) * _powers(_INVERSE, self.sums.size)[starts])

    def every(self, width: int) -> np.ndarray:
        """The fingerprint of the range of `width` bytes at every position."""
        n = self.sums.size - width
        return mix((self.sums[width:] - self.sums[:n]) * _powers(_INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = x.size - width + 1
    whole = np.full(-(-x.size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: x.size] = x
    rows = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, first, last, anchor, key, context) of each run of strings with one anchor, in order.

    first and last are the first and last string's positions in data, anchor the anchor's. key orders suffixes by their
    first four bytes, then by a fingerprint of the gram. context is a fingerprint of all bytes that the run's strings cover.
    """
    none = np.zeros(0, np.int64)
    if data.size < length:
        return none, none, none, none, none, none
    sums = Prefixes(data)
    grams = sums.every(GRAM)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams.size, dtype=np.uint64)
    least = (_sliding_least(packed, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(data.size + 1, np.int8)
    full = np.flatnonzero(np.diff(offsets) >= length)
    inside[offsets[full]] += 1
    np.subtract.at(inside, offsets[full + 1] - length + 1, 1)
    at = np.flatnonzero(np.cumsum(inside[: least.size]) > 0)
    least = least[at]
    new = np.ones(at.size, bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    first, anchor = at[begin], least[begin]
    last = at[np.append(begin[1:], at.size) - 1] if at.size else none
    lead = np.zeros(anchor.size, np.uint64)
    for i in range(4):
        lead = (lead << np.uint64(8)) | data[anchor + i].astype(np.uint64)
    key = (lead << np.uint64(32)) | (grams[anchor] & np.uint64(0xFFFFFFFF))
    context = mix(sums.of(first, last + length) ^ (anchor - first).astype(np.uint64))
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first, last, anchor, (key ^ np.uint64(1 << 63)).astype(np.int64), context.astype(np.int64)
