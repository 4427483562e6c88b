"""Vectorised byte-level text helpers used inside Arrow tasks.

A batch of texts is one ``uint8`` array with offsets, taken from Arrow's own buffers.  Everything
here is numpy over whole batches; Spark deals the batches out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_powers.get("p", ())) < n:
        m = max(n, 1 << 18)
        for name, base in (("p", _P), ("i", _PI)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["p"][:n], _powers["i"][:n]


class Rolling:
    """Hash of any range of one array in O(1) each, from a prefix sum of weighted values (of bytes, if not given)."""

    def __init__(self, data: np.ndarray, values: np.ndarray | None = None):
        p, self.inv = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE[data] if values is None else values) * p[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hashes of data[start:end]; equal bytes, equal hash."""
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Mixed hashes of every k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inv[:n] + np.uint64(k)) if n > 0 else np.zeros(0, np.uint64)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space after each, and the start of each text in that array."""
    lens = np.diff(offsets)
    n = len(lens)
    starts = offsets[:-1] - offsets[0] + np.arange(n)
    out = np.full(int(offsets[-1] - offsets[0]) + n, 32, data.dtype)
    keep = np.ones(len(out), bool)
    keep[starts + lens] = False
    out[keep] = data[offsets[0] : offsets[-1]]
    return out, starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) in order, and the text each one is in."""
    flat, starts = spaced(data, offsets)
    if lower:
        flat = LOWER[flat]
    begin, end = word_bounds(flat)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return Rolling(flat).of(begin, end), np.searchsorted(starts, begin, "right") - 1


def word_bounds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes or code points that are not ASCII white space; flat ends in a space."""
    solid = ~SPACE[flat] if flat.dtype == np.uint8 else (flat >= 256) | ~SPACE[flat & 255]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text): distinct k-word shingles of each text, sorted.

    A text with one to k-1 words has its whole word sequence as its only shingle; without words none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    a = np.uint64(0xD6E8FEB86659FD93)
    full = len(words) - k + 1
    rolled = np.zeros(0, np.uint64)
    if full > 0:
        rolled = np.zeros(full, np.uint64)
        for i in range(k):
            rolled = rolled * a + words[i : i + full]
        rolled = mix(rolled)
    parts, sizes = [], np.zeros(n_docs, np.int64)
    for d in np.flatnonzero(counts):
        s, e = first[d], first[d + 1]
        if e - s >= k:
            part = rolled[s : e - k + 1]
            part = np.unique(part) if len(part) > 1 else part
        else:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[s:e]:
                    h = h * a + w
                part = mix(np.array([h + np.uint64(e - s)]))
        parts.append(part)
        sizes[d] = len(part)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
