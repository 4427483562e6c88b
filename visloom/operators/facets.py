"""Wavelets on facets: squares of an image with the pixels after them that their filters reach, wrapped at the image's ends.

A coefficient belongs to the facet in which its first pixel lies, so a facet's coefficients follow from its own pixels and the ones
after them, at any number of levels.  The adjoint gives sums over the same pixels; sums of overlapping facets add up.  Together the
facets are the periodic bases of ``wavelets``, each over sqrt(number of bases), and the pixels themselves as the last basis.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from visloom.operators.wavelets import daubechies, high_pass


def _filtered(x: np.ndarray, taps: np.ndarray, count: int) -> np.ndarray:
    """sum_j taps[j] x[2k + j] for k < count, along the first axis."""
    out = np.zeros((count, *x.shape[1:]))
    for j, t in enumerate(taps):
        out += t * x[j : j + 2 * count : 2]
    return out


def _spread(c: np.ndarray, taps: np.ndarray, length: int) -> np.ndarray:
    """The adjoint of ``_filtered``."""
    out = np.zeros((length, *c.shape[1:]))
    for j, t in enumerate(taps):
        out[j : j + 2 * len(c) : 2] += t * c
    return out


@dataclass(frozen=True)
class Words:
    """Bases of an image of ``side`` pixels, cut into facets of at most ``width`` pixels a side."""

    side: int
    orders: tuple[int, ...] = tuple(range(1, 9))
    most_levels: int = 2
    width: int = 128
    levels: int = field(init=False)
    facets: tuple[tuple[int, int], ...] = field(init=False)

    def __post_init__(self):
        levels = self.most_levels
        while levels and self.side % (1 << levels):
            levels -= 1
        if self.width % (1 << levels):
            raise ValueError(f"a facet's width must be a multiple of {1 << levels}")
        object.__setattr__(self, "levels", levels)
        object.__setattr__(self, "facets", tuple((s, min(self.width, self.side - s)) for s in range(0, self.side, self.width)))

    @property
    def scale(self) -> float:
        return 1 / math.sqrt(len(self.orders) + 1)

    @property
    def reach(self) -> int:
        """Pixels after a facet that its coefficients depend on."""
        return self._after(2 * max(self.orders, default=1), 0)

    def _after(self, taps: int, level: int) -> int:
        return (taps - 1) * ((1 << (self.levels - level)) - 1)

    def size(self, a: int, b: int) -> int:
        """Number of coefficients of facet (a, b)."""
        return (len(self.orders) + 1) * self.facets[a][1] * self.facets[b][1]

    def analysis(self, pixels: np.ndarray, w: int, h: int) -> np.ndarray:
        """(bases, w, h) from the (w + reach, h + reach) pixels of a facet of w x h."""
        out = np.zeros((len(self.orders) + 1, w, h))
        for order, c in zip(self.orders, out):
            low = daubechies(order)
            high, now = high_pass(low), pixels
            for level in range(1, self.levels + 1):
                p, q, after = w >> level, h >> level, self._after(len(low), level)
                lines, rest = _filtered(now, low, p + after), _filtered(now, high, p)
                c[:p, q : 2 * q] = _filtered(lines[:p].T, high, q).T
                c[p : 2 * p, :q] = _filtered(rest.T, low, q).T
                c[p : 2 * p, q : 2 * q] = _filtered(rest.T, high, q).T
                now = _filtered(lines.T, low, q + after).T
            c[: w >> self.levels, : h >> self.levels] = now[: w >> self.levels, : h >> self.levels]
        out[-1] = pixels[:w, :h]
        return out * self.scale

    def adjoint(self, coefficients: np.ndarray, w: int, h: int) -> np.ndarray:
        """(w + reach, h + reach) sums from the (bases, w, h) coefficients of a facet."""
        out = np.zeros((w + self.reach, h + self.reach))
        for order, c in zip(self.orders, coefficients):
            low = daubechies(order)
            high, now = high_pass(low), c[: w >> self.levels, : h >> self.levels]
            for level in range(self.levels, 0, -1):
                p, q, after = w >> level, h >> level, self._after(len(low), level - 1)
                wide, tall = 2 * q + after, 2 * p + after
                lines = _spread(now.T, low, wide).T
                lines[:p] += _spread(c[:p, q : 2 * q].T, high, wide).T
                rest = _spread(c[p : 2 * p, :q].T, low, wide).T + _spread(c[p : 2 * p, q : 2 * q].T, high, wide).T
                now = _spread(lines, low, tall) + _spread(rest, high, tall)
            out[: now.shape[0], : now.shape[1]] += now
        out[:w, :h] += coefficients[-1]
        return out * self.scale
