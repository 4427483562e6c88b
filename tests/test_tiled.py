"""Images as lines against the ones that fit a task, adjoint identities, and norms against dense eigenvalues."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visloom.operators import fourier, gridding, tiled


def rows_of(n, seed=0, keys=2):
    rng = np.random.default_rng(seed)
    u, v = rng.uniform(-math.pi, math.pi, (2, n))
    return list(zip(*[x.tolist() for x in (rng.integers(0, keys, n), u, v, *rng.normal(size=(2, n)), rng.uniform(0.5, 2, n))]))


KIND = "ch int, u double, v double, re double, im double, weight double"


def frame(spark, n=400, seed=0, keys=2):
    return spark.createDataFrame(rows_of(n, seed, keys), KIND).repartition(3)


def grid(df, name, side, key=None):
    pdf = df.toPandas() if key is None else df.where(F.col("ch") == key).toPandas()
    out = np.full((side, side), np.nan)
    out[pdf["y"] + side // 2, pdf["x"] + side // 2] = pdf[name]
    return out


def test_two_dimensional_transform(spark, monkeypatch):
    monkeypatch.setattr(tiled, "BLOCK", 5)
    z = np.random.default_rng(0).normal(size=(12, 16)) + 1j
    rows = [(k, i, (z[i] * (k + 1)).view(float).tolist()) for k in range(2) for i in range(12) if i != 3]
    z[3] = 0
    lines = spark.createDataFrame(rows, "k int, line int, v array<double>")
    over = tiled.mapped(tiled.transposed(tiled.mapped(lines, ["k"], lambda a: np.fft.fft(a, axis=1)), ["k"], 12), ["k"], lambda a: np.fft.fft(a, axis=1))
    got = {(r["k"], r["line"]): np.array(r["v"]).view(complex) for r in over.collect()}
    assert len(got) == 32
    for k in range(2):
        assert np.allclose(np.array([got[k, i] for i in range(16)]).T, np.fft.fft2(z * (k + 1)))


@pytest.mark.parametrize("side", [7, 64])
def test_image_equals_the_one_of_a_task(spark, side):
    vis = frame(spark)
    a, b = tiled.dirty_image(vis, side, ["ch"]), gridding.dirty_image(vis, side, ["ch"])
    for key in (0, 1):
        for name in ("dirty", "psf"):
            x, y = grid(a, name, side, key), grid(b, name, side, key)
            assert np.abs(x - y).max() < 1e-9 * np.abs(y).max()
    assert grid(tiled.dirty_image(vis, side), "dirty", side).shape == (side, side)
    assert tiled.dirty_image(vis.limit(0), side, ["ch"]).count() == 0


def test_large_image_has_bounded_tasks(spark):
    """2048 pixels a side, beyond what a task may hold; checked at some pixels by exact sums."""
    rows = rows_of(60, 4, 1)
    vis = spark.createDataFrame(rows, KIND)
    side = 2048
    cells = gridding.spread(vis, side, ["ch"])
    lines = tiled.image_lines(tiled.lines_of(cells, ["ch"], "gy", "gx", 2 * side, "re", "im"), ["ch"], side)
    x = 100
    line = np.array(lines.where(F.col("line") == x).first()["v"]).view(complex).real
    y = np.arange(side) - side // 2
    want = sum(w * (re * np.cos(u * (x - side // 2) + v * y) - im * np.sin(u * (x - side // 2) + v * y)) for _, u, v, re, im, w in rows)
    assert np.abs(line - want).max() < 1e-4 * np.abs(want).max()


@pytest.mark.parametrize("side", [8, 100])
def test_forward_and_adjoint_identity(spark, monkeypatch, side):
    """<F x, y> = <x, F* y>; crowded tiles are dealt to several parts."""
    monkeypatch.setattr(tiled, "PART", 50)
    rng = np.random.default_rng(1)
    vis = frame(spark, 300, 2)
    x = rng.normal(size=(2, side, side))
    image = spark.createDataFrame([(k, int(i) - side // 2, int(j) - side // 2, float(x[k, i, j])) for k in range(2) for i in range(side) for j in range(side)], "ch int, y int, x int, v double")
    got = tiled.predicted(vis, image, side, ["ch"]).toPandas()
    assert len(got) == 300
    near = gridding.predicted(vis.where("ch = 1"), x[1]).toPandas().sort_values(["u"])
    own = got[got.ch == 1].sort_values("u")
    for c in ("re_model", "im_model"):
        assert np.abs(own[c].to_numpy() - near[c].to_numpy()).max() < 1e-9 * np.abs(near[c]).max()
    left = (got.weight * (got.re_model * got.re + got.im_model * got.im)).sum()
    back = tiled.dirty_image(vis, side, ["ch"])
    right = sum((grid(back, "dirty", side, k) * x[k]).sum() for k in range(2))
    assert abs(left - right) < 1e-9 * abs(left)


def test_rows_without_a_place(spark):
    vis = spark.createDataFrame([(0, None, 1.0, 1.0, 0.0, 1.0), (0, 0.5, 0.5, 1.0, 0.0, 1.0), (1, 0.5, 0.5, 1.0, 0.0, 1.0), (None, 0.5, 0.5, 1.0, 0.0, 1.0)], KIND)
    image = spark.createDataFrame([(0, 0, 0, 2.0)], "ch int, y int, x int, v double")
    got = {(r["ch"], r["u"]): r["re_model"] for r in tiled.predicted(vis, image, 8, ["ch"]).collect()}
    assert got[0, None] is None and abs(got[0, 0.5] - 2) < 1e-4 and got[1, 0.5] == 0 and got[None, 0.5] is None


def test_w_stacks(spark):
    side, pixel = 16, 0.02
    rng = np.random.default_rng(5)
    vis = frame(spark, 250, 6).withColumn("stack", (F.abs(F.hash("u")) % 3).cast("int")).withColumn("w0", (F.col("stack") - 1) * 40.0)
    exact = grid(fourier.stacked_image(vis.where("ch = 0"), side, pixel), "dirty", side)
    found = tiled.stacked_image(vis, side, pixel, ["ch"])
    assert np.abs(grid(found, "dirty", side, 0) - exact).max() < 1e-5 * np.abs(exact).max()
    x = rng.normal(size=(2, side, side))
    image = spark.createDataFrame([(k, int(i) - side // 2, int(j) - side // 2, float(x[k, i, j])) for k in range(2) for i in range(side) for j in range(side)], "ch int, y int, x int, v double")
    got = tiled.stacked_predicted(vis, image, side, pixel, ["ch"]).toPandas()
    left = (got.weight * (got.re_model * got.re + got.im_model * got.im)).sum()
    right = sum((grid(found, "dirty", side, k) * x[k]).sum() for k in range(2))
    assert len(got) == 250 and abs(left - right) < 1e-9 * abs(left)
    # the definition, at every row of one image
    axis = np.arange(side) - side // 2
    n = np.sqrt(1 - (axis[:, None] * pixel) ** 2 - (axis[None, :] * pixel) ** 2)
    for r in got[got.ch == 1].itertuples():
        wave = np.exp(-1j * (r.v * axis[:, None] + r.u * axis[None, :] + 2 * math.pi * r.w0 * (n - 1)))
        assert abs((x[1] / n * wave).sum() - (r.re_model + 1j * r.im_model)) < 1e-4 * np.abs(x[1]).sum()
    one = tiled.stacked_predicted(vis.drop("ch"), image.where("ch = 0").drop("ch"), side, pixel)
    assert one.count() == 250


def test_norms_against_dense_eigenvalues(spark):
    side = 6
    vis = frame(spark, 120, 9)
    found = {r["ch"]: r for r in tiled.operator_norms(vis, side, ["ch"], tolerance=1e-7).collect()}
    axis = np.arange(side) - side // 2
    for key in (0, 1):
        rows = [r for r in rows_of(120, 9) if r[0] == key]
        waves = np.array([np.exp(-1j * (v * axis[:, None] + u * axis[None, :])).ravel() for _, u, v, *_ in rows])
        w = np.array([r[5] for r in rows])
        for name, p in (("norm", 1), ("norm_prime", 2)):
            want = np.linalg.eigvalsh((waves.conj().T * w**p @ waves).real)[-1]
            assert abs(found[key][name] - want) < 1e-6 * want, (name, found[key][name] / want - 1)
        assert found[key]["settled"] and found[key]["rounds"] <= 36
    short = tiled.operator_norms(vis, side, ["ch"], tolerance=1e-12, most=2).collect()
    assert not any(r["settled"] for r in short) and all(r["rounds"] == 2 for r in short)


@pytest.mark.parametrize("dense", [0, 1 << 20])
def test_rows_are_spread_in_their_batch(spark, monkeypatch, dense):
    """Sums by cell equal the definition for null keys, rows without a number and several chunks; no row is made for a row's cell."""
    monkeypatch.setattr(gridding, "DENSE", dense)
    monkeypatch.setattr(gridding, "CHUNK", 40)
    rng = np.random.default_rng(5)
    rows = [(k, f"p{i % 2}", *map(float, rng.uniform(-4, 4, 2)), *map(float, rng.normal(size=2)), float(rng.uniform(0.5, 2))) for i in range(150) for k in [(0, 1, None)[i % 3]]]
    bad = [(0, "p0", None, 0.0, 1.0, 1.0, 1.0), (0, "p0", math.nan, 0.0, 1.0, 1.0, 1.0), (1, "p1", 0.0, 0.0, None, 1.0, 1.0)]
    vis = spark.createDataFrame(rows + bad, "ch int, pol string, u double, v double, re double, im double, weight double").repartition(2)
    found = gridding.spread(vis, 8, ["ch", "pol"])
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want: dict[tuple, np.ndarray] = {}
    for ch, pol, u, v, re, im, w in rows:
        at = [x * 16 / (2 * math.pi) for x in (v, u)]
        for j in range(gridding.WIDTH):
            for i in range(gridding.WIDTH):
                cell = [math.ceil(at[0] - gridding.WIDTH / 2) + j, math.ceil(at[1] - gridding.WIDTH / 2) + i]
                k = w * float(np.prod([gridding._bell(np.array((a - c) * (2 / gridding.WIDTH))) for a, c in zip(at, cell)]))
                key = (ch, pol, cell[0] % 16, cell[1] % 16)
                want[key] = want.get(key, np.zeros(4)) + k * np.array([re, im, 1.0, w])
    got = {(r["ch"], r["pol"], r["gy"], r["gx"]): np.array([r["re"], r["im"], r["weight"], r["square"]]) for r in found.collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]).max() for k in want) < 1e-12
    assert gridding.spread(vis.where("ch > 5"), 8, ["ch", "pol"]).count() == 0
