"""Gridded Fourier sums: each visibility is spread over a few cells of an oversampled grid.

The adjoint spreads rows in Arrow batches and groups by cell, so partial sums leave each task and the work is
rows x WIDTH squared whatever the image's size; one FFT of the summed grid and a division by the kernel's own transform give the image.
The forward map goes the other way: the transformed model, at most (OVER * MAX_SIDE) squared cells, is broadcast and
rows gather their cells without a shuffle.  With width 7 and twofold oversampling the relative error is below 1e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_SIDE = 1024
OVER = 2
WIDTH = 7
BETA = 2.3 * WIDTH
CHUNK = 65_536  # rows that are spread together
DENSE = 1 << 20  # cells of a chunk's keys that are summed as whole grids


def _bell(z: np.ndarray) -> np.ndarray:
    """The spreading kernel, of support [-1, 1]."""
    return np.where(np.abs(z) <= 1, np.exp(BETA * (np.sqrt(np.maximum(0, 1 - z * z)) - 1)), 0.0)


def transform_of_bell(side: int) -> np.ndarray:
    """The kernel's transform at the pixels -side//2 ... of one axis."""
    nodes, weights = np.polynomial.legendre.leggauss(80)
    half = WIDTH / 2
    angle = 2 * math.pi / (OVER * side) * np.outer(np.arange(side) - side // 2, nodes * half)
    return (np.cos(angle) * (_bell(nodes) * weights * half)).sum(axis=1)


def _checked(side: int, most: float = MAX_SIDE) -> int:
    if not 1 <= side <= most:
        raise ValueError(f"an image has 1 to {most} pixels a side")
    if OVER * side < WIDTH:
        raise ValueError("the grid is narrower than the kernel")
    return OVER * side


def spread(vis: DataFrame, side: int, keys: list[str] = []) -> DataFrame:
    """Rows (keys, u, v in [-pi, pi], re, im, weight) -> keys, gy, gx, re, im, weight, square: sums by cell.

    ``square`` sums the squared weights, for the norm of the operator that is weighted twice.

    Rows with a null take no part.  Cells wrap around, as the grid is periodic.  A task spreads CHUNK rows at a time and sums what falls
    into one cell; only the sums of the cells that were met become rows, which are grouped by cell.
    """
    cells = _checked(side, math.inf)
    rows = vis.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("u", "v", "re", "im", "weight")]).na.drop(subset=["u", "v", "re", "im", "weight"])
    names = [*keys, "gy", "gx", "re", "im", "weight", "square"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            columns = [table.column(i).chunk(0) for i in range(table.num_columns)]
            first, group = _groups(columns[: len(keys)], table.num_rows)
            to, sums = _cell_sums(group, len(first), *(c.to_numpy() for c in columns[len(keys) :]), cells)
            for s in range(0, len(to), CHUNK):
                own, cell = np.divmod(to[s : s + CHUNK], cells * cells)
                place = [pa.array(a.astype(np.int32)) for a in np.divmod(cell, cells)]
                same = [c.take(pa.array(first[own])) for c in columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*same, *place, *(pa.array(x[s : s + CHUNK]) for x in sums)], names)

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "gy int, gx int, re double, im double, weight double, square double"])
    return rows.mapInArrow(run, schema).groupBy(*keys, "gy", "gx").agg(*[F.sum(c).alias(c) for c in names[-4:]])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at least CHUNK rows, but for the last one, of one chunk a column."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(keys: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct key, and the number of each row's key."""
    code = np.zeros(rows, np.int64)
    for k in keys:
        own = k.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


def _cell_sums(group: np.ndarray, groups: int, u: np.ndarray, v: np.ndarray, re: np.ndarray, im: np.ndarray, weight: np.ndarray, cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places (group, gy, gx as one number) that rows reach, and their sums of kernel times re, im, weight and its square."""
    size, step = groups * cells * cells, CHUNK // 4
    dense = size <= DENSE
    found: list[tuple[np.ndarray, list[np.ndarray]]] = []
    met, total = (np.zeros(size, bool), [np.zeros(size) for _ in range(4)]) if dense else (None, [])
    for s in range(0, len(u), step):
        part = np.arange(s, min(s + step, len(u)))
        part = part[np.isfinite(u[part]) & np.isfinite(v[part])]
        at, bells = [], []
        for a in (v[part], u[part]):
            where = a * (cells / (2 * math.pi))
            near = np.ceil(where - WIDTH / 2)[:, None] + np.arange(WIDTH)
            at.append(np.mod(near, cells).astype(np.int64))
            bells.append(_bell((where[:, None] - near) * (2 / WIDTH)))
        to = ((group[part] * cells)[:, None, None] + at[0][:, :, None]) * cells + at[1][:, None, :]
        with np.errstate(invalid="ignore", over="ignore"):
            times = bells[0][:, :, None] * bells[1][:, None, :] * weight[part][:, None, None]
            values = [(times if x is None else times * x[part][:, None, None]).ravel() for x in (re, im, None, weight)]
        if dense:
            met[to.ravel()] = True
            for t, x in zip(total, values):
                t += np.bincount(to.ravel(), x, size)
        else:
            places, number = np.unique(to.ravel(), return_inverse=True)
            found.append((places, [np.bincount(number, x, len(places)) for x in values]))
    if dense:
        places = np.flatnonzero(met)
        return places, [t[places] for t in total]
    places, number = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return places, [np.bincount(number, np.concatenate([f[1][i] for f in found]), len(places)) for i in range(4)]


def image_of(cells: pd.DataFrame, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dirty image, PSF, and PSF under squared weights, from the summed cells of one image."""
    n = OVER * side
    shape, back = transform_of_bell(side), np.arange(side) - side // 2
    grid = np.zeros((3, n, n), complex)
    y, x = cells["gy"].to_numpy(), cells["gx"].to_numpy()
    grid[0, y, x] = cells["re"].to_numpy() + 1j * cells["im"].to_numpy()
    grid[1, y, x] = cells["weight"].to_numpy()
    grid[2, y, x] = cells["square"].to_numpy()
    out = [(np.fft.ifft2(g) * n * n).real[np.ix_(back % n, back % n)] / np.outer(shape, shape) for g in grid]
    return out[0], out[1], out[2]


def dirty_image(vis: DataFrame, side: int, keys: list[str] = []) -> DataFrame:
    """keys, y, x, dirty, psf for each value of the keys; an image is transformed in the task that its cells meet in."""
    grouped = list(keys) or ["one"]
    _checked(side)
    cells = spread(vis, side, keys)
    if not keys:
        cells = cells.withColumn("one", F.lit(0))

    def transformed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dirty, psf, _ = image_of(pdf, side)
        axis = (np.arange(side) - side // 2).astype(np.int32)
        out = pd.DataFrame({"y": np.repeat(axis, side), "x": np.tile(axis, side), "dirty": dirty.ravel(), "psf": psf.ravel()})
        for name, value in zip(reversed(grouped), reversed(key)):
            out.insert(0, name, value)
        return out

    types = dict(cells.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in grouped] + ["y int", "x int", "dirty double", "psf double"])
    found = cells.groupBy(*grouped).applyInPandas(transformed, schema)
    return found if keys else found.drop("one")


def predicted(vis: DataFrame, image: np.ndarray) -> DataFrame:
    """Adds re_model, im_model: the sum of pixels times exp(-i (u x + v y)), gathered from the model's transform."""
    side = image.shape[0]
    n = _checked(side)
    if image.shape != (side, side):
        raise ValueError("the model is square")
    shape, back = transform_of_bell(side), np.arange(side) - side // 2
    wide = np.zeros((n, n))
    wide[np.ix_(back % n, back % n)] = image / np.outer(shape, shape)
    shared = vis.sparkSession.sparkContext.broadcast(np.fft.fft2(wide))  # bounded by MAX_SIDE
    names, u_at, v_at = vis.columns, vis.columns.index("u"), vis.columns.index("v")

    def gathered(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        grid, total = shared.value, np.zeros(len(u), complex)
        place = [a * (n / (2 * math.pi)) for a in (v, u)]
        first = [np.ceil(p - WIDTH / 2) for p in place]
        taps = [[((f + j) % n, _bell((p - f - j) * (2 / WIDTH))) for j in range(WIDTH)] for p, f in zip(place, first)]
        for gy, ky in taps[0]:
            for gx, kx in taps[1]:
                total += grid[gy.astype(np.int64), gx.astype(np.int64)] * (ky * kx)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (u_at, v_at))
            known = ~(np.isnan(u) | np.isnan(v))
            y = np.full(len(u), np.nan, complex)
            y[known] = gathered(u[known], v[known])
            models = [pa.array(part.copy(), from_pandas=True) for part in (y.real, y.imag)]
            yield pa.RecordBatch.from_arrays([*b.columns, *models], [*names, "re_model", "im_model"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vis.schema.fields)
    return vis.mapInArrow(run, f"{schema}, re_model double, im_model double")
