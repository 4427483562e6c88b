"""Hashed word and character n-gram features of text batches, shared by the two classifiers."""

from __future__ import annotations

import numpy as np

from visloom.llm.textbytes import LOWER, Rolling, mix, spaced, word_bounds

WORD_SEED, AGAIN_SEED, SPREAD = np.uint64(0xA5A5A5A5), np.uint64(0x5A5A5A5A5A5A), np.uint64(0x9E3779B97F4A7C15)
FAR = 8


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and the offsets of the texts among them."""
    begins = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(begins)])
    if at[-1] == len(data):
        return data.astype(np.uint32), offsets
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), at[offsets]


def features(data: np.ndarray, offsets: np.ndarray, bits: int, grams: tuple[int, ...], words: bool, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, first feature of each text) of a batch, texts in order.

    A text's features are its character n-grams of the sizes ``grams``, 2 at least, of the text with a space
    at both ends, and with ``words`` its words and, for each word, the distance (1 to FAR words, or none) at
    which the same word stands before it: what words a text repeats differs, that it repeats does not.
    """
    n = len(offsets) - 1
    points, at = characters(data, offsets)
    flat, starts = spaced(points, at)
    if lower:
        flat = np.where(flat < 128, LOWER[flat & 127], flat)
    flat = np.concatenate([np.array([32], flat.dtype), flat])  # the space before the first text
    roll, shift, found = Rolling(flat, mix(flat.astype(np.uint64) + np.uint64(7))), np.uint64(64 - bits), []
    ends = np.concatenate([starts[1:], [len(flat) - 1]])  # the space after each text
    for k in grams:
        h = roll.grams(k)
        own = np.ones(len(h), bool)
        for d in range(1, k - 1):  # a gram from here passes the space after its text
            edge = (ends - d)[ends - d >= starts]
            own[edge[edge < len(h)]] = False
        found.append(((h[own] >> shift).astype(np.int64), np.maximum(ends - starts + 2 - k, 0)))
    if words:
        begin, end = word_bounds(flat)
        h, first = roll.of(begin, end) + WORD_SEED, np.searchsorted(begin, starts + 1)
        many = np.diff(np.append(first, len(begin)))
        found.append(((h * SPREAD >> shift).astype(np.int64), many))
        gap, within = np.zeros(len(h), np.uint64), np.arange(len(h)) - np.repeat(first, many)
        for d in range(FAR, 0, -1):
            gap[d:][(h[d:] == h[:-d]) & (within[d:] >= d)] = d
        found.append((((gap + np.uint64(1)) * AGAIN_SEED * SPREAD >> shift).astype(np.int64), many))
    total = np.sum([many for _, many in found], axis=0)
    first = np.cumsum(total) - total
    out, filled = np.zeros(int(total.sum()), np.int64), np.zeros(n, np.int64)
    for bucket, many in found:
        out[np.repeat(first + filled - np.cumsum(many) + many, many) + np.arange(len(bucket))] = bucket
        filled += many
    return out, first


def means(found: tuple[np.ndarray, np.ndarray], table: np.ndarray, n: int) -> np.ndarray:
    """Mean row of ``table`` over each text's features; zeros for a text without any."""
    bucket, first = found
    size = np.diff(np.concatenate([first, [len(bucket)]]))
    sums = np.zeros((n, table.shape[1]))
    if len(bucket):
        sums[size > 0] = np.add.reduceat(table[bucket], first[size > 0], axis=0)
    return sums / np.maximum(size, 1)[:, None]


def sparse(found: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text such that weights @ table[buckets] is its row of means()."""
    bucket, first = found
    out = []
    for s, e in zip(first, [*first[1:], len(bucket)]):
        b, c = np.unique(bucket[s:e], return_counts=True)
        out.append((b, (c / max(e - s, 1)).astype(np.float32)))
    return out
