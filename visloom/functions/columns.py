"""Column helpers: complex values as pairs of columns, proximity steps, coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from visloom.sources.tables import LIGHT


def times(re1: Column, im1: Column, re2: Column, im2: Column) -> tuple[Column, Column]:
    """Product of two complex values."""
    return re1 * re2 - im1 * im2, re1 * im2 + im1 * re2


def turned(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """(re + i im) * exp(i angle)."""
    return times(re, im, F.cos(angle), F.sin(angle))


def wavelengths(metres: Column, freq_hz: Column) -> Column:
    return metres * freq_hz / F.lit(LIGHT)


def clipped(x: Column, low: Column | float, high: Column | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lift(low), F.least(lift(high), x))


def soft(x: Column, t: float) -> Column:
    """Proximity operator of t times the absolute value."""
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def soft_dual(x: Column, t: float) -> Column:
    """x less its soft threshold: the value cut to [-t, t]."""
    return clipped(x, -t, t)


def reweighted(x: Column, eps: float) -> Column:
    return F.lit(eps) / (F.lit(eps) + F.abs(x))


def cell(angle: Column, size: int) -> Column:
    """Grid cell of a coordinate in [-pi, pi); the cell before the first is the last one."""
    return F.pmod(F.floor((angle + math.pi) * size / 2 / math.pi).cast("int") - 1, F.lit(size))


def logged(x: Column, a: float, top: Column) -> Column:
    """Logarithmic display scale of an image with peak top."""
    return top * F.log10(a * x / top + 1) / F.log10(F.lit(a))


def logged_unit(x: Column, a: float, top: Column) -> Column:
    """The same scale with peak one."""
    return F.log10(a * x / top + 1) / F.log10(F.lit(a))


def n_term(l: Column, m: Column) -> Column:  # noqa: E741
    return F.sqrt(1 - l * l - m * m)
