"""Reconstruction loops, each run for one image in the task that holds its grid cells (``imager.images``).

All loops work on the dirty image and Gram kernel; the primal-dual ones also need the norm of the data, as their dual value per
visibility is always the forward map of an image less a multiple of the data.  Each result says in its columns ``rounds`` and
``settled`` how many rounds were run and whether the stopping rule was met before the limit, and in ``sigma`` which denoiser was last used.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from visloom.operators.wavelets import daubechies, high_pass
from visloom.plans.imager import Outcome, Reduced, images

Prox = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Rounds:
    """Stopping rules: inner steps, outer rounds, and the relative variation that ends each."""

    inner: int = 2000
    least: int = 200
    inner_tolerance: float = 1e-5
    outer: int = 20
    outer_tolerance: float = 1e-3
    noise_scale: float = 1.0


def variation(new: np.ndarray, old: np.ndarray) -> float:
    return float(np.linalg.norm(new - old) / (np.linalg.norm(new) + 1e-10))


class Dictionary:
    """Orthonormal wavelet bases and the Dirac basis, each over sqrt(number of bases), so that analysis keeps the norm."""

    def __init__(self, side: int, orders: tuple[int, ...] = tuple(range(1, 9)), levels: int = 2):
        while levels and side % (1 << levels):
            levels -= 1
        self.scale = 1 / math.sqrt(len(orders) + 1)
        self.bases = [[self._step(order, side >> level) for level in range(levels)] for order in orders] + [[]]

    @staticmethod
    def _step(order: int, n: int) -> np.ndarray:
        low = daubechies(order)
        m = np.zeros((n, n))
        for k in range(n // 2):
            for j, (lo, hi) in enumerate(zip(low, high_pass(low))):
                m[k, (2 * k + j) % n] += lo
                m[n // 2 + k, (2 * k + j) % n] += hi
        return m

    def analysis(self, x: np.ndarray) -> np.ndarray:
        out = []
        for steps in self.bases:
            c = x.copy()
            for m in steps:
                n = len(m)
                c[:n, :n] = m @ c[:n, :n] @ m.T
            out.append(c)
        return np.stack(out) * self.scale

    def synthesis(self, coefficients: np.ndarray) -> np.ndarray:
        total = np.zeros(coefficients.shape[1:])
        for steps, c in zip(self.bases, coefficients):
            c = c.copy()
            for m in reversed(steps):
                n = len(m)
                c[:n, :n] = m.T @ c[:n, :n] @ m
            total += c
        return total * self.scale


def sparse_positive(words: Dictionary, threshold: float, weights: np.ndarray | None = None, steps: int = 20, tolerance: float | None = 1e-4, warm: bool = True) -> Prox:
    """Proximity step of weighted l1 in the dictionary plus positivity, by dual forward-backward; ``warm`` keeps the dual between calls.

    Without a tolerance all steps are run.
    """
    held: dict[str, np.ndarray] = {}
    bound = threshold if weights is None else threshold * weights

    def step(x: np.ndarray) -> np.ndarray:
        dual = held.get("dual", np.zeros((len(words.bases), *x.shape)))
        out, before = np.maximum(x - words.synthesis(dual), 0), math.inf
        for _ in range(steps):
            dual = np.clip(dual + words.analysis(out), -bound, bound)
            out = np.maximum(x - words.synthesis(dual), 0)
            value = 0.5 * np.sum((out - x) ** 2) + np.sum(bound * np.abs(words.analysis(out)))
            if tolerance is not None and abs(value - before) <= tolerance * abs(value):
                break
            before = value
        if warm:
            held["dual"] = dual
        return out

    return step


def heuristic(data: Reduced, scale: float = 1.0) -> float:
    """Noise level of an image: 1 / sqrt(2 norm), corrected where squaring the weights changes the norm."""
    return scale / math.sqrt(2 * data.norm) * math.sqrt(data.norm_prime / data.norm)


def _forward_backward(data: Reduced, model: np.ndarray, prox: Prox, rounds: Rounds) -> tuple[np.ndarray, bool]:
    """The model, and whether it stopped varying before the limit."""
    gamma = 1.98 / data.norm
    for i in range(rounds.inner):
        before, model = model, prox(model - gamma * (data.apply(model) - data.dirty))
        if i + 1 >= rounds.least and variation(model, before) < rounds.inner_tolerance:
            return model, True
    return model, False


def reweighted_sparse(vis: DataFrame, side: int, rounds: Rounds = Rounds(), keys: list[str] = [], warm: bool = True) -> DataFrame:
    """Reweighted l1 reconstruction: weights eps / (eps + |coefficient|) are renewed after each inner solution.

    With ``warm`` off each proximity step starts from a dual of zero and runs all its rounds.
    """

    def loop(data: Reduced) -> Outcome:
        words = Dictionary(side)
        floor = heuristic(data, rounds.noise_scale) / math.sqrt(len(words.bases))
        model, weights, done, settled = np.zeros((side, side)), None, 0, False
        while done < rounds.outer and not settled:
            before = model
            step = sparse_positive(words, floor, weights, tolerance=1e-4 if warm else None, warm=warm)
            model, still = _forward_backward(data, model, step, rounds)
            weights = floor / (floor + np.abs(words.analysis(model)))
            done, settled = done + 1, still and variation(model, before) < rounds.outer_tolerance
        return Outcome(model, done, settled)

    return images(vis, side, loop, keys)


def pick(shelf: list[float], ratio: float) -> tuple[float, float, float]:
    """The largest noise level not above the ratio (else the smallest), and the ratios low <= r < high for which that stands."""
    low = max((s for s in shelf if s <= ratio), default=0.0)
    return low or min(shelf), low, min((s for s in shelf if s > ratio), default=math.inf)


class ShelfStep:
    """Proximity step by a denoiser from a shelf of noise levels, chosen again when the peak settles outside its range.

    ``denoiser(image, sigma)`` works on an image scaled so that the noise heuristic equals sigma.
    """

    def __init__(self, data: Reduced, shelf: list[float], denoiser: Callable[[np.ndarray, float], np.ndarray], noise_scale: float, peak_tolerance: float):
        self.shelf, self.denoiser, self.tolerance = shelf, denoiser, peak_tolerance
        self.level = heuristic(data, noise_scale)
        self.peak = max(float(data.dirty.max()) / data.peak, 1e-10)
        self.sigma, self.low, self.high = pick(shelf, self.level / self.peak)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scale = self.level / self.sigma
        return np.maximum(self.denoiser(x / scale, self.sigma) * scale, 0)

    def update(self, model: np.ndarray) -> None:
        top = max(float(model.max()), 1e-10)
        steady, self.peak = abs(top - self.peak) < self.tolerance * self.peak, top
        if steady and not self.low <= self.level / self.peak < self.high:
            self.sigma, self.low, self.high = pick(self.shelf, self.level / self.peak)


def denoised(vis: DataFrame, side: int, shelf: list[float], denoiser: Callable[[np.ndarray, float], np.ndarray], rounds: Rounds = Rounds(), peak_tolerance: float = 0.1, keys: list[str] = []) -> DataFrame:
    """Forward-backward with a denoiser from a shelf."""

    def loop(data: Reduced) -> Outcome:
        step = ShelfStep(data, shelf, denoiser, rounds.noise_scale, peak_tolerance)
        model, gamma, done, steady = np.zeros((side, side)), 1.98 / data.norm, 0, False
        while done < rounds.inner and not steady:
            before, model = model, step(model - gamma * (data.apply(model) - data.dirty))
            step.update(model)
            done += 1
            steady = done >= rounds.least and variation(model, before) < rounds.inner_tolerance
        return Outcome(model, done, steady, step.sigma)

    return images(vis, side, loop, keys)


def _primal_dual(data: Reduced, radius: float, step: Prox, update: Callable[[np.ndarray], None], rounds: Rounds) -> Outcome:
    """Primal-dual loop whose weighted residual norm is held to ``radius``.

    The trial dual is q = dual + forward(2 x - x') - data, and projection on the ball leaves the dual (1 - s) q with
    s = min(1, radius / |q|).  From a dual of 0, q is forward(a) - b data for an image a and a number b in every round, so its
    norm and its adjoint image follow from the Gram operator, the dirty image and the norm of the data: no round reads the rows.
    It ends when the model has settled and its residual is within the radius.
    """
    gamma = 0.5 / data.norm

    def norm(image: np.ndarray, times: float) -> float:
        """Of forward(image) - times * data."""
        return math.sqrt(max(0.0, float(np.sum(image * data.apply(image)) - 2 * times * np.sum(image * data.dirty)) + times * times * data.energy))

    model, a, b = np.zeros_like(data.dirty), np.zeros_like(data.dirty), 0.0
    done, settled = 0, False
    while done < rounds.inner and not settled:
        before, model = model, step(model - gamma * (data.apply(a) - b * data.dirty))
        update(model)
        a, b = a + 2 * model - before, b + 1
        length = norm(a, b)
        keep = 1 - min(1.0, radius / length) if length else 0.0
        a, b, done = keep * a, keep * b, done + 1
        settled = done >= rounds.least and variation(model, before) < rounds.inner_tolerance and norm(model, 1.0) <= radius * (1 + rounds.inner_tolerance)
    return Outcome(model, done, settled)


def bound(rows: int) -> float:
    """Radius that the residual of unit noise keeps to: sqrt(m + 2 sqrt(m))."""
    return math.sqrt(rows + 2 * math.sqrt(rows))


def constrained(vis: DataFrame, side: int, radius: float | None, prox: Prox, rounds: Rounds = Rounds(), keys: list[str] = []) -> DataFrame:
    """Primal-dual reconstruction held to ``radius``, or to the bound of each image's number of rows."""

    def loop(data: Reduced) -> Outcome:
        return _primal_dual(data, bound(data.rows) if radius is None else radius, prox, lambda model: None, rounds)

    return images(vis, side, loop, keys, totals=True)


def constrained_denoised(vis: DataFrame, side: int, radius: float | None, shelf: list[float], denoiser: Callable[[np.ndarray, float], np.ndarray], rounds: Rounds = Rounds(), peak_tolerance: float = 0.1, keys: list[str] = []) -> DataFrame:
    """Primal-dual reconstruction with a denoiser from a shelf as its proximity step; data are not preconditioned."""

    def loop(data: Reduced) -> Outcome:
        step = ShelfStep(data, shelf, denoiser, rounds.noise_scale, peak_tolerance)
        found = _primal_dual(data, bound(data.rows) if radius is None else radius, step, step.update, rounds)
        return Outcome(found.model, found.rounds, found.settled, step.sigma)

    return images(vis, side, loop, keys, totals=True)
