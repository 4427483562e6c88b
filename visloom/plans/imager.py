"""Image reconstruction: Spark reduces the visibilities of each image to the cells of a grid, and a loop in the task that holds an
image's cells refines the model.

Everything that grows with the rows happens in one aggregation by key and cell.  The dirty image and the kernel of the Gram operator
(the adjoint of the forward operator applied to it, which depends only on pixel differences) follow from the cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from visloom.operators import gridding

MAX_SIDE = 512


@dataclass(frozen=True)
class Settings:
    """Stopping rules and strengths of the loop."""

    side: int = 8
    iterations: int = 2000
    least: int = 200
    tolerance: float = 1e-5
    scale: float = 1.0

    def __post_init__(self):
        if not 2 <= self.side <= MAX_SIDE:
            raise ValueError(f"side must be 2 to {MAX_SIDE}")


def as_array(image: DataFrame, value: str, side: int) -> np.ndarray:
    """A long image of side * side pixels as an array; pixel 0 is the corner."""
    out = np.zeros((side, side))
    for r in image.select("y", "x", value).collect():
        out[r["y"] + side // 2, r["x"] + side // 2] = r[value]
    return out


def gram(kernel: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Convolution with a kernel of twice the side, by FFT."""
    n = kernel.shape[0] // 2
    spectrum = np.fft.rfft2(np.fft.ifftshift(kernel))

    def apply(x: np.ndarray) -> np.ndarray:
        return np.fft.irfft2(np.fft.rfft2(x, kernel.shape) * spectrum, kernel.shape)[:n, :n]

    return apply


def norm_of(apply: Callable[[np.ndarray], np.ndarray], side: int, rounds: int = 50) -> float:
    """Largest eigenvalue by the power method."""
    x = np.random.default_rng(0).normal(size=(side, side))
    value = 1.0
    for _ in range(rounds):
        x = apply(x / np.linalg.norm(x))
        value = float(np.linalg.norm(x))
    return value


def sparse_positive(threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """Proximity step: soft threshold of one Haar level, then cut at zero."""

    def level(x: np.ndarray) -> np.ndarray:
        s, d = (x[0::2] + x[1::2]) / math.sqrt(2), (x[0::2] - x[1::2]) / math.sqrt(2)
        return np.concatenate([s, d])

    def back(c: np.ndarray) -> np.ndarray:
        h = len(c) // 2
        out = np.empty_like(c)
        out[0::2], out[1::2] = (c[:h] + c[h:]) / math.sqrt(2), (c[:h] - c[h:]) / math.sqrt(2)
        return out

    def step(x: np.ndarray) -> np.ndarray:
        c = level(level(x).T).T
        return np.maximum(back(back((np.sign(c) * np.maximum(np.abs(c) - threshold, 0)).T).T), 0)

    return step


@dataclass
class Reduced:
    """What a loop needs of one image's visibilities: dirty image, Gram operator, its norm, the norm under squared weights, PSF peak,
    and where asked for the weighted energy and number of the rows."""

    dirty: np.ndarray
    apply: Callable[[np.ndarray], np.ndarray]
    norm: float
    norm_prime: float
    peak: float
    energy: float = 0.0
    rows: int = 0


@dataclass
class Outcome:
    """A loop's model, its rounds, whether its stopping rule was met before the limit, and the last denoiser's noise level."""

    model: np.ndarray
    rounds: int
    settled: bool
    sigma: float | None = None


Loop = Callable[[Reduced], Outcome]


def _reduced(cells: pd.DataFrame, side: int) -> Reduced:
    dirty, kernel, square = gridding.image_of(cells, 2 * side)  # the kernel needs all pixel differences; its middle is the dirty image
    middle = slice(side - side // 2, side - side // 2 + side)
    apply = gram(kernel)
    norm = norm_of(apply, side) or 1.0
    totals = (float(cells["energy"].iloc[0]), int(cells["rows"].iloc[0])) if "energy" in cells else (0.0, 0)
    return Reduced(dirty[middle, middle], apply, norm, norm_of(gram(square), side) or norm, float(kernel[side, side]) or 1.0, *totals)


def images(vis: DataFrame, side: int, loop: Loop, keys: list[str] = [], totals: bool = False) -> DataFrame:
    """Reconstructs one image for each value of ``keys`` (one in all without keys) from rows (keys, u, v, re, im, weight).

    Spark spreads the rows over grid cells and sums them by key and cell; the cells of an image, at most (4 side) squared, meet in one
    task, which runs the loop.  So images are solved side by side on the executors, and nothing passes through the driver.
    Returns keys, y, x, dirty, model, residual (both over the PSF peak), rounds, settled, sigma; no rows give no image.
    """
    if not 2 <= side <= MAX_SIDE:
        raise ValueError(f"side must be 2 to {MAX_SIDE}")
    by = list(keys) or ["one"]
    rows = vis if keys else vis.withColumn("one", F.lit(0))
    cells = gridding.spread(rows, 2 * side, by)
    if totals:
        power = F.sum(F.col("weight") * (F.col("re") ** 2 + F.col("im") ** 2))
        used = rows.select(*by, "u", "v", "re", "im", "weight").na.drop(subset=["u", "v", "re", "im", "weight"])
        cells = cells.join(used.groupBy(*by).agg(power.alias("energy"), F.count(F.lit(1)).alias("rows")), by)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = _reduced(pdf, side)
        found = loop(data)
        axis = (np.arange(side) - side // 2).astype(np.int32)
        residual = (data.dirty - data.apply(found.model)) / data.peak
        out = {"y": np.repeat(axis, side), "x": np.tile(axis, side), "dirty": data.dirty.ravel() / data.peak, "model": found.model.ravel(), "residual": residual.ravel()}
        return pd.DataFrame({**dict(zip(by, key)), **out, "rounds": found.rounds, "settled": found.settled, "sigma": found.sigma})

    types = dict(cells.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in by] + ["y int, x int, dirty double, model double, residual double, rounds int, settled boolean, sigma double"])
    out = cells.groupBy(*by).applyInPandas(solve, schema)
    return out if keys else out.drop("one")


def reconstruct(vis: DataFrame, settings: Settings = Settings(), prox: Callable[[np.ndarray], np.ndarray] | None = None, keys: list[str] = []) -> DataFrame:
    """Forward-backward reconstruction of rows (u, v, re, im, weight), one image for each value of ``keys``.

    The proximity step that is taken where none is given halves the image, so the side must be even.
    """
    if prox is None and settings.side % 2:
        raise ValueError("without a proximity step of your own the side must be even")

    def loop(data: Reduced) -> Outcome:
        gamma = 1.98 / data.norm
        step = prox or sparse_positive(settings.scale * gamma * 1e-3 * float(np.abs(data.dirty).max(initial=0)))
        model = np.zeros_like(data.dirty)
        for i in range(settings.iterations):
            before, model = model, step(model - gamma * (data.apply(model) - data.dirty))
            if i + 1 >= settings.least and np.linalg.norm(model - before) <= settings.tolerance * (np.linalg.norm(model) + 1e-10):
                return Outcome(model, i + 1, True)
        return Outcome(model, settings.iterations, False)

    return images(vis, settings.side, loop, keys)


def metrics(image: DataFrame) -> DataFrame:
    """Norms and spread of the residual, against those of the dirty image."""
    return image.agg(F.stddev_samp("residual").alias("residual_std"), F.sqrt(F.sum(F.col("residual") ** 2)).alias("residual_norm"), F.sqrt(F.sum(F.col("dirty") ** 2)).alias("dirty_norm"))
