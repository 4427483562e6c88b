"""Facets against whole bases, and the loop over lines and facets against the same rounds on dense arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.operators import tiled
from visloom.operators.facets import Words
from visloom.plans import sparse_lines
from visloom.plans.solvers import Dictionary, Rounds, pick
from visloom.plans.sparse_lines import SIGMA, TAU, sparse

KIND = "ch int, u double, v double, re double, im double, weight double"


def rows_of(n, seed=0, keys=2):
    rng = np.random.default_rng(seed)
    u, v = rng.uniform(-math.pi, math.pi, (2, n))
    return list(zip(*[x.tolist() for x in (rng.integers(0, keys, n), u, v, *rng.normal(size=(2, n)), rng.uniform(0.5, 2, n))]))


@pytest.mark.parametrize("side, width", [(8, 8), (16, 8), (24, 16), (10, 128), (7, 128), (64, 32)])
def test_facets_are_the_bases(side, width):
    words, whole = Words(side, width=width), Dictionary(side)
    x = np.random.default_rng(side).normal(size=(side, side))
    total, norm = np.zeros((side, side)), 0.0
    for s, w in words.facets:
        for t, h in words.facets:
            at = np.ix_((s + np.arange(w + words.reach)) % side, (t + np.arange(h + words.reach)) % side)
            c = words.analysis(x[at], w, h)
            norm += np.sum(c**2)
            np.add.at(total, at, words.adjoint(np.clip(c, -0.1, 0.1), w, h))
    assert math.isclose(norm, np.sum(x**2), rel_tol=1e-12)
    assert np.abs(total - whole.synthesis(np.clip(whole.analysis(x), -0.1, 0.1))).max() < 1e-12


def system(rows, side):
    """Forward map as a matrix, weights, data, and the bounds of the kernel's norm."""
    u, v, re, im, weight = np.array(rows).T
    p = np.arange(side) - side // 2
    phi = np.exp(-1j * (v[:, None, None] * p[:, None] + u[:, None, None] * p)).reshape(len(u), -1)
    wide = np.arange(2 * side) - side
    kernels = [np.einsum("n,ny,nx->yx", w, np.exp(1j * np.outer(v, wide)), np.exp(1j * np.outer(u, wide))).real for w in (weight, weight**2)]
    top, square = (np.abs(np.fft.fft2(np.fft.ifftshift(k))).max() for k in kernels)
    return phi, weight, re + 1j * im, top, square


def dense(rows, side, inner, outer, radius=None):
    """The rounds of ``sparse`` with the forward map as a matrix: model, dirty over peak, residual over peak."""
    phi, weight, vis, top, square = system(rows, side)
    back = lambda z: (phi.conj().T @ (weight * z)).real.reshape(side, side) / top
    apply = lambda x: back(phi @ x.ravel())
    words = Dictionary(side)
    lam = math.sqrt(square / top) / math.sqrt(2 * top) / 3 / 1.98
    d, bound, dual = back(vis), lam, 0.0
    x = xp = np.zeros((side, side))
    values = np.zeros(len(vis), complex)  # the dual of each visibility
    for o in range(outer):
        for _ in range(inner):
            dual = np.clip(dual + SIGMA * words.analysis(2 * x - xp), -bound, bound)
            if radius is None:
                g = apply(x) - d
            else:
                q = values + SIGMA * (phi @ (2 * x - xp).ravel() - vis)
                length = math.sqrt(np.sum(weight * np.abs(q) ** 2))
                values = q * (1 - min(1, SIGMA * radius / length))
                g = back(values)
            last = x
            x, xp = np.maximum(0, x - TAU * (g + words.synthesis(dual))), x
        if o + 1 < outer:
            bound = lam * 1.98 * lam / (1.98 * lam + np.abs(words.analysis(x)))
    peak = weight.sum() / top
    return last, d / peak, (d - apply(last)) / peak


@pytest.mark.parametrize("radius", [None, 8.0])
def test_rounds_equal_dense_ones(spark, monkeypatch, radius):
    monkeypatch.setattr(sparse_lines, "BLOCK", 12)
    monkeypatch.setattr(sparse_lines, "LINES", 5)
    data, side = rows_of(300), 16
    limits = Rounds(inner=3, least=200, outer=2)
    out = sparse(spark.createDataFrame([(*r, 1) for r in data], KIND + ", line int").repartition(3), side, ["ch"], limits, radius, Words(side, width=8))
    assert out.columns == ["ch", "y", "x", "dirty", "model", "residual", "rounds", "solutions", "settled"]
    pdf = out.toPandas()
    assert len(pdf) == 2 * side * side and set(pdf["rounds"]) == {3} and set(pdf["solutions"]) == {2} and not pdf["settled"].any()
    for ch in (0, 1):
        own = pdf[pdf["ch"] == ch].sort_values(["y", "x"])
        found = [own[c].to_numpy().reshape(side, side) for c in ("model", "dirty", "residual")]
        expected = dense([r[1:] for r in data if r[0] == ch], side, 3, 2, radius)
        for a, b in zip(found, expected):
            assert np.abs(b).max() > 0 and np.abs(a - b).max() < 1e-4 * np.abs(b).max()


def test_without_keys_nulls_and_rows(spark):
    side, limits = 8, Rounds(inner=2, least=1, outer=1)
    data = rows_of(60, 3, 1)
    spoiled = [*data, (None, *data[0][1:]), (0, None, *data[0][2:]), (0, *data[0][1:3], None, *data[0][4:]), (5, *data[0][1:5], 0.0)]
    a = sparse(spark.createDataFrame(data, KIND), side, ["ch"], limits).orderBy("y", "x").toPandas()
    b = sparse(spark.createDataFrame(spoiled, KIND), side, ["ch"], limits).orderBy("y", "x").toPandas()
    assert set(b["ch"]) == {0} and np.allclose(a["model"], b["model"], atol=1e-12)
    c = sparse(spark.createDataFrame(data, KIND), side, rounds=limits)
    assert "one" not in c.columns and np.allclose(c.orderBy("y", "x").toPandas()["model"], a["model"], atol=1e-12)
    assert sparse(spark.createDataFrame([], KIND), side, ["ch"], limits).count() == 0
    with pytest.raises(ValueError):
        sparse(spark.createDataFrame(data, KIND), side, ["ch"], limits, words=Words(16))
    with pytest.raises(ValueError):
        sparse(spark.createDataFrame(data, KIND).withColumnRenamed("ch", "x"), side, ["x"], limits)


def test_settles_on_a_sky(spark):
    """Two points seen without noise: the loop ends by its rules, and the model is near the sky."""
    rng = np.random.default_rng(1)
    u, v = rng.uniform(-math.pi, math.pi, (2, 400))
    sky = {(-2, 1): 3.0, (1, -1): 5.0}
    vis = sum(a * np.exp(-1j * (v * y + u * x)) for (y, x), a in sky.items())
    rows = list(zip([0] * 400, *[c.tolist() for c in (u, v, vis.real, vis.imag, np.ones(400))]))
    limits = Rounds(inner=40, least=3, inner_tolerance=1e-2, outer=2, outer_tolerance=5e-2)
    out = sparse(spark.createDataFrame(rows, KIND), 8, ["ch"], limits).toPandas()
    assert out["settled"].all() and out["rounds"].max() < 40
    for r in out.itertuples():
        assert abs(r.model - sky.get((r.y, r.x), 0.0)) < 0.1


def smoother():
    """A denoiser that tasks get by value, as they cannot import tests."""

    def smooth(pixels, sigma):
        wide = np.pad(pixels, 1)
        h, w = pixels.shape
        mean = sum(wide[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9
        return np.maximum(0.2 * mean + 0.8 * pixels - 0.05 * sigma, 0)

    return smooth


@pytest.mark.parametrize("radius", [None, 8.0])
def test_denoiser_on_facets_equals_whole_images(spark, radius):
    data, side, shelf, smooth = rows_of(200, 5, 1), 16, [1e-4, 1e-3, 1e-2, 1e-1], smoother()
    out = sparse_lines.denoised(spark.createDataFrame(data, KIND), side, shelf, smooth, 1, ["ch"], Rounds(inner=3, least=200), radius, width=8)
    own = out.orderBy("y", "x").toPandas()
    assert list(own.columns) == ["ch", "y", "x", "dirty", "model", "residual", "rounds", "settled", "sigma"] and set(own["rounds"]) == {3}
    phi, weight, vis, top, square = system([r[1:] for r in data], side)
    back = lambda z: (phi.conj().T @ (weight * z)).real.reshape(side, side) / top
    d = back(vis)
    level = math.sqrt(square / top) / math.sqrt(2 * top)
    peak = d.max() * top / weight.sum()
    sigma, low, high = pick(shelf, level / peak)
    x = xp = np.zeros((side, side))
    values = np.zeros(len(vis), complex)
    for _ in range(3):
        if radius is None:
            z = x - 1.98 * (back(phi @ x.ravel()) - d)
        else:
            q = values + phi @ (2 * x - xp).ravel() - vis
            values = q * (1 - min(1, radius / math.sqrt(np.sum(weight * np.abs(q) ** 2))))
            z = x - 0.5 * back(values)
        last, scale = x, level / sigma
        x, xp = np.maximum(smooth(z / scale, sigma) * scale, 0), x
        steady, peak = abs(x.max() - peak) < 0.1 * peak, x.max()
        if steady and not low <= level / peak < high:
            sigma, low, high = pick(shelf, level / peak)
    assert set(own["sigma"]) == {sigma} and last.max() > 0
    assert np.abs(own["model"].to_numpy().reshape(side, side) - last).max() < 1e-4 * last.max()
