"""Exact Fourier sums between visibilities and a pixel grid of fixed size.

The phase u x + v y splits into a factor of x and one of y, so a batch of rows meets the grid in one matrix product.
Adjoint sums leave each task as one partial image, and only those are shuffled; the forward sum is a
map over rows with the image, at most MAX_SIDE pixels a side, in the closure.  Rows with a null value take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visloom.functions import columns as C

MAX_SIDE = 1024
BLOCK = 4096


def _axis(n: int) -> np.ndarray:
    if not 1 <= n <= MAX_SIDE:
        raise ValueError(f"an image has 1 to {MAX_SIDE} pixels a side")
    return np.arange(n) - n // 2


def _phases(angle: np.ndarray, axis: np.ndarray) -> np.ndarray:
    return np.exp(1j * np.outer(angle, axis))


def _blocks(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    for s in range(0, batch.num_rows, BLOCK):
        yield [v[s : s + BLOCK] for v in values]


def dirty_image(vis: DataFrame, n: int) -> DataFrame:
    """Adjoint sum of weighted rows (u, v in [-pi, pi], re, im, weight) on n x n pixels, and the PSF: y, x, dirty, psf."""
    axis = _axis(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dirty, psf, rows = np.zeros((n, n)), np.zeros((n, n)), 0
        for b in batches:
            for u, v, re, im, w in _blocks(b):
                ex, ey = _phases(u, axis), _phases(v, axis).T
                dirty += (ey @ ((w * (re + 1j * im))[:, None] * ex)).real
                psf += (ey @ (w[:, None] * ex)).real
                rows += len(u)
        if rows:
            y, x = np.repeat(axis, n).astype(np.int32), np.tile(axis, n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (y, x, dirty.ravel(), psf.ravel())], ["y", "x", "dirty", "psf"])

    parts = vis.select(*[F.col(c).cast("double") for c in ("u", "v", "re", "im", "weight")]).na.drop().mapInArrow(run, "y int, x int, dirty double, psf double")
    return parts.groupBy("y", "x").agg(F.sum("dirty").alias("dirty"), F.sum("psf").alias("psf"))


def stacked_image(vis: DataFrame, n: int, pixel: float) -> DataFrame:
    """Adjoint sum with the w term of each row's stack (columns stack, w0 in wavelengths): y, x, dirty.

    Each stack has one complex partial image a task; the correction exp(2 pi i w0 (n - 1)) / n is applied once to its sum.
    """
    axis = _axis(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, float], np.ndarray] = {}
        for b in batches:
            for u, v, re, im, w, stack, w0 in _blocks(b):
                ey, ex = _phases(v, axis).T, (w * (re + 1j * im))[:, None] * _phases(u, axis)
                for s in np.unique(stack):
                    of = stack == s
                    at = (int(s), float(w0[of][0]))
                    sums[at] = sums.get(at, 0) + ey[:, of] @ ex[of]
        y, x = np.repeat(axis, n).astype(np.int32), np.tile(axis, n).astype(np.int32)
        for (s, centre), image in sums.items():
            flat = image.ravel()
            cols = [np.full(n * n, s, np.int32), np.full(n * n, centre), y, x, flat.real.copy(), flat.imag.copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["stack", "w0", "y", "x", "re", "im"])

    rows = vis.select(*[F.col(c).cast("double") for c in ("u", "v", "re", "im", "weight")], F.col("stack").cast("int"), F.col("w0").cast("double")).na.drop()
    sums = rows.mapInArrow(run, "stack int, w0 double, y int, x int, re double, im double").groupBy("stack", "w0", "y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    height = C.n_term(F.col("x") * pixel, F.col("y") * pixel)
    real, _ = C.turned(F.col("re"), F.col("im"), 2 * math.pi * F.col("w0") * (height - 1))
    return sums.withColumn("dirty", real / height).groupBy("y", "x").agg(F.sum("dirty").alias("dirty"))


def predicted(vis: DataFrame, image: np.ndarray) -> DataFrame:
    """Adds re_model, im_model: the sum of image pixels times exp(-i (u x + v y)).  Null where u or v is null."""
    axis_y, axis_x = _axis(image.shape[0]), _axis(image.shape[1])
    names, u_at, v_at = vis.columns, vis.columns.index("u"), vis.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (u_at, v_at))
            out = [np.einsum("ij,ij->i", _phases(-v[s : s + BLOCK], axis_y) @ image, _phases(-u[s : s + BLOCK], axis_x)) for s in range(0, len(u), BLOCK)]
            y = np.concatenate(out) if out else np.zeros(0, complex)
            models = [pa.array(part.copy(), from_pandas=True) for part in (y.real, y.imag)]
            yield pa.RecordBatch.from_arrays([*b.columns, *models], [*names, "re_model", "im_model"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vis.schema.fields)
    return vis.mapInArrow(run, f"{schema}, re_model double, im_model double")


def noise_level(vis: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """One row: spread of back-projected complex noise of unit power over the peaks of the PSF and of the dirty image.

    The noise is a portable hash of the row's keys; its two parts have half the power each.
    """
    mixed = lambda a, b: ((F.col("ant1") * a + F.col("ant2") * b + F.col("t") * 7919 + F.col("ch") * 31 + seed * 104729) % 10007 + 0.5) / 10007.0
    radius, angle = F.sqrt(-F.log(mixed(613, 1297))), 2 * math.pi * mixed(3571, 8191)
    rows = vis.withColumns({"re": radius * F.cos(angle), "im": radius * F.sin(angle), "weight": F.col("nw")})
    image, data = dirty_image(rows, n), dirty_image(vis.withColumn("weight", F.col("nw") * F.col("nw")), n)
    peaks = data.agg(F.max("psf").alias("peak"), F.max("dirty").alias("brightest"))
    found = image.agg(F.stddev_samp("dirty").alias("spread")).crossJoin(F.broadcast(peaks))  # one row each
    return found.withColumn("level", F.col("spread") / F.col("peak") / F.col("brightest"))
